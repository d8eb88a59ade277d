"""One query for each operator of this subpackage, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidlake.llm import bpe, chat, counts, jaccard, licenses, mixing, quality, sharding, suffixes, topk
from braidlake.llm.common import table

W = r"[^\x20\x09-\x0D]+"


def op1_bpe_encoding(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, keep_ids=False)


def op2_chat_format(spark, sf_dir):
    made = chat.format_chats(table(spark, sf_dir, "conversations"))
    return made.select("conv_id", "segment", "n_turns", "cost", "roles", "actions", "rendered")


def op5_token_counts(spark, sf_dir):
    import public_tokenizers

    return counts.edited_counts(table(spark, sf_dir, "documents"), None, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, redact=r"\d{4,}|[\w.+-]+@[\w.-]+")


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_exact_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter(F.col("vec_id") % 50 == 0), 5)


def op4_suffix_array_dedup(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=False)


def op6_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(*quality.VERDICT)


def op8_ngram_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.tree(8), sharding.grow(sharding.tree(8)))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe_encoding, op2_chat_format, op3_exact_topk, op4_suffix_array_dedup, op5_token_counts, op6_quality_rules, op7_license_scan, op8_ngram_jaccard_join, op9_mixing_sources, op10_sharding)
}

_U = "((('0x' || substr(md5('{level}:{name}:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def _followed_sql(level: str, weights: dict[int, float]) -> str:
    """The child with the least draw; the first on a tie."""
    if len(weights) == 1:
        return str(next(iter(weights)))
    draws = ", ".join(f"-ln({_U.format(level=level, name=name)}) / {w!r}" for name, w in weights.items())
    return f"[{', '.join(map(str, weights))}][list_position([{draws}], list_min([{draws}]))]"


def _tree_sql(leaves: list) -> str:
    """The shard to which doc_id descends: region, then rack, then shard."""
    regions = sharding.nested(leaves)
    region = _followed_sql("region", {r: sum(sum(y.values()) for y in x.values()) for r, x in regions.items()})
    ways = []
    for r, x in regions.items():
        rack = _followed_sql("rack", {k: sum(y.values()) for k, y in x.items()})
        ways.append(f"WHEN {r} THEN CASE {rack} " + " ".join(f"WHEN {k} THEN {_followed_sql('shard', y)}" for k, y in x.items()) + " END")
    return f"(CASE {region} {' '.join(ways)} END)::INTEGER"


def _repair_sql() -> str:
    """The automaton's dynamic programme as a recursion over turns: a cost and a way for each state."""
    never, states = 10**9, chat.STATES
    best, ways = [], []
    for t in (1, 2, 3):
        change = f"CASE WHEN role = '{states[t]}' THEN 0 ELSE {chat.RELABEL} END"
        name = f"CASE WHEN role = '{states[t]}' THEN 'keep' ELSE 'relabel' END"
        found = []  # (from, further cost, action, inserted) in order of preference
        for p in range(4):
            if t in chat.FOLLOWS[p]:
                found.append((p, 0, name, ""))
            elif t == p:
                found.append((p, chat.MERGE, "'merge'", ""))
            found += [(p, chat.INSERT, f"'insert+' || {name}", states[x]) for x in chat.FOLLOWS[p] if t in chat.FOLLOWS[x]]
        costs = ", ".join(f"{{'c': c{p} + {extra} + {change}, 'i': {i}}}" for i, (p, extra, _, _) in enumerate(found))
        best.append(f"list_min([{costs}]) AS b{t}")
        cases = " ".join(f"WHEN {i} THEN list_append(s{p}, '{states[t]}|' || {action} || '|{x}')" for i, (p, _, action, x) in enumerate(found))
        ways.append(f"CASE b{t}.i {cases} END")
    return f"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, role, text, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
        ), dp(conv_id, place, c0, c1, c2, c3, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, {never}::BIGINT, {never}::BIGINT, {never}::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM t
            UNION ALL
            SELECT conv_id, place, {never}, b1.c, b2.c, b3.c, s0, {", ".join(ways)} FROM (
                SELECT t.conv_id, t.place, t.role, c0, c1, c2, c3, s0, s1, s2, s3, {", ".join(best)} FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.place = dp.place + 1
            )
        ), won AS (
            SELECT dp.conv_id, x.c AS cost, x.s AS way FROM (SELECT DISTINCT conv_id, n FROM t) t JOIN dp ON dp.conv_id IS NOT DISTINCT FROM t.conv_id AND dp.place = t.n,
            LATERAL (SELECT list_min([{{'c': c1, 't': 1, 's': s1}}, {{'c': c2, 't': 2, 's': s2}}, {{'c': c3, 't': 3, 's': s3}}]) AS x)
        ), steps AS (
            SELECT t.conv_id, t.place, cost, string_split(way[place], '|') AS w, replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS body
            FROM t JOIN won ON won.conv_id IS NOT DISTINCT FROM t.conv_id
        )
        SELECT conv_id, 0::BIGINT AS segment, count(*) AS n_turns, max(cost) AS cost, list(w[1] ORDER BY place) AS roles, list(w[2] ORDER BY place) AS actions,
               string_agg(CASE WHEN w[3] <> '' THEN '<|' || w[3] || '|>' || chr(10) || chr(10) ELSE '' END || CASE WHEN w[2] = 'merge' THEN '' ELSE '<|' || w[1] || '|>' || chr(10) END || body || chr(10), '' ORDER BY place) AS rendered
        FROM steps GROUP BY conv_id"""


_quoted = lambda text: "'" + text.replace("'", "''") + "'"
_LICENSES = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, bodies in sorted(licenses.catalogue().items()) for body in bodies)


def _license(text: str) -> str:
    """The digest of a text's canonical form: lines that state a copyright go."""
    before, holder, none = licenses.HOLDER
    stated, named, other = (_quoted(rf"^{licenses.LEAD}(?:{x})$") for x in (licenses.STATED, before + holder, f"{before}(?:{none})[^\n]*"))
    lines = f"list_filter(string_split({text}, chr(10)), lambda x: NOT (regexp_matches(x, {stated}) OR (regexp_matches(x, {named}) AND NOT regexp_matches(x, {other}))))"
    out = rf"trim(regexp_replace(lower(array_to_string({lines}, chr(10))), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"
    for a, b in licenses.SPELLINGS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"sha256({out})"


SQL = {
    "op2_chat_format": _repair_sql(),
    "op3_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5""",
    "op4_suffix_array_dedup": f"""
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
        ), w AS (
            SELECT doc_id, i, md5(t[i + 1 : i + {suffixes.LENGTH}]) AS m FROM (SELECT doc_id, t, unnest(range(n - {suffixes.LENGTH} + 1)) AS i FROM d WHERE n >= {suffixes.LENGTH})
        ), s AS (SELECT doc_id, i FROM w WHERE m IN (SELECT m FROM w GROUP BY 1 HAVING count(*) > 1)
        ), g AS (
            SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffixes.LENGTH} THEN 1 ELSE 0 END AS new FROM s
        ), runs AS (
            SELECT doc_id, min(i) AS a, max(i) + {suffixes.LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k
        ), cuts AS (
            SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 9223372036854775807) AS b FROM (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, -1, 0 FROM d)
        ), kept AS (
            SELECT doc_id, string_agg(hex(t[a + 1 : least(b, n)]), '' ORDER BY a) AS h FROM cuts JOIN d USING (doc_id) WHERE a < least(b, n) GROUP BY 1
        )
        SELECT doc_id, n AS n_bytes, coalesce(r.gone, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM runs GROUP BY 1) r USING (doc_id)""",
    "op6_quality_rules": rf"""
        WITH d AS (
            SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '{W}') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{W}')) AS l
            FROM documents
        ), win AS (
            SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
        ), twice AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (
                SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
            ) GROUP BY 1
        ), lines AS (
            SELECT doc_id, source, text, i, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(x, '{W}')) AS nw
            FROM (
                SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i
                FROM (SELECT DISTINCT doc_id, source, text FROM documents)
            ) WHERE regexp_matches(x, '{W}')
        ), boiler AS (
            SELECT source, line, min(doc_id) AS first FROM lines GROUP BY 1, 2 HAVING count(DISTINCT text) > {quality.LINE_LIMIT}
        ), removed AS (
            SELECT l.doc_id, l.source, l.text, sum(l.nw)::BIGINT AS removed_words FROM lines l
            JOIN boiler b ON b.source IS NOT DISTINCT FROM l.source AND b.line = l.line
            WHERE l.doc_id IS DISTINCT FROM b.first GROUP BY 1, 2, 3
        ), m AS (
            SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                   (length(coalesce(d.text, '')) - length(translate(coalesce(d.text, ''), '#*$%&|<>', '')))::BIGINT AS n_symbols,
                   (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(t.n, 0)::BIGINT AS n_repeat_words,
                   coalesce(r.removed_words, 0)::BIGINT AS removed_words
            FROM d LEFT JOIN twice t USING (doc_id)
            LEFT JOIN removed r ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.source IS NOT DISTINCT FROM d.source AND r.text = d.text
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * (n_words - removed_words) < {quality.MIN_LEFT_PERCENT} * n_words) AS kept,
               removed_words
        FROM m""",
    "op7_license_scan": f"""
        WITH known AS (
            SELECT digest, min(name) AS license_id FROM (SELECT name, {_license("body")} AS digest FROM (VALUES {_LICENSES}) v(name, body)) GROUP BY 1
        )
        SELECT doc_id, d.digest, license_id FROM (SELECT doc_id, {_license("coalesce(text, '')")} AS digest FROM documents) d LEFT JOIN known USING (digest)""",
    "op8_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.y FROM reach r JOIN links l ON r.b = l.x
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.m, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) c ON c.a = d.doc_id""",
    "op10_sharding": f"""
        WITH RECURSIVE crc AS (
            SELECT i, 0 AS k, i AS c FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
        ), rule AS (SELECT list(c::BIGINT ORDER BY i) AS t FROM crc WHERE k = 8
        ), bytes AS (
            SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), p AS (
            SELECT doc_id, n::BIGINT + 1 AS size,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(n), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
                                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32,
                   {_tree_sql(sharding.tree(8))} AS shard, {_tree_sql(sharding.grow(sharding.tree(8)))} AS grown_shard
            FROM bytes, rule
        ), b AS (
            SELECT *, floor((('0x' || substr(md5('block:' || doc_id::VARCHAR || ':' || text_crc32::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * {sharding.BLOCKS})::BIGINT AS block
            FROM p
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
        FROM b""",
}
