"""License scan by canonical digest lookup (DataFrame functions only)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices that are whole texts of their own.
NOTICES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
}
#: Spellings that count as one.
SPELLINGS = {"licence": "license", "sub license": "sublicense", "noncommercial": "non commercial", "organisation": "organization", "favour": "favor"}


#: Titles that a license may bear or not, and other accepted wordings (from, to) of a whole license text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD License"),
    "Unlicense": ("The Unlicense",),
}
WORDINGS = (
    (r"(?m)^([ \t]*)[123]\. (?=Redistributions|Neither)", r"\1* "),
    (r"COPYRIGHT\s+HOLDER OR CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    (r"AND THE AUTHOR DISCLAIMS", "AND ISC DISCLAIMS"),
    (r"THE\s+AUTHOR BE LIABLE", "ISC BE LIABLE"),
)
#: The terms of these end at a line of their own; what follows tells how to apply them.
END = "END OF TERMS AND CONDITIONS"
#: A line that states a copyright: the word with a sign, a year, a place for one, or a holder in capitals; a sign; or that all rights are reserved.
_YEAR = r"(?:19|20)\d\d"
LEAD = r"[ \t\r#*/;%!|-]*"
STATED = (
    rf"(?i:copyright)[ \t:,]*(?:(?i:\(c\))|©|[\[<{{]|{_YEAR})[^\n]*"
    rf"|©[^\n]*|(?i:\(c\))[ \t]*(?:(?i:copyright)\b|[\[<{{]|{_YEAR})[^\n]*"
    r"|(?i:all rights reserved)[.!]?[ \t\r]*"
)
#: Of a holder: what comes before, how one begins, and words that are none.
HOLDER = (r"Copyright[ \t]+(?:by[ \t]+|the[ \t]+)?", r"[\p{Lu}\p{Lo}][^\n]*", r"(?i:holders?|owners?|notices?|laws?|licen[cs]es?|act|and|or)\b")
STATEMENT = rf"(?md)^{LEAD}(?:{STATED}|{HOLDER[0]}(?!{HOLDER[2]}){HOLDER[1]})$"


def wordings(name: str, text: str) -> list[str]:
    """A whole license text in each accepted wording, with each of its titles and with none."""
    out = [text]
    if END in text:
        out.append(text[: text.index(END) + len(END)])
    for old, new in WORDINGS:
        out += [re.sub(old, new, t) for t in out]
    return sorted({f"{title}\n\n{t}" for t in out for title in ("", *TITLES.get(name, ()))})


def catalogue() -> dict[str, list[str]]:
    """Accepted wordings by identifier: the whole texts in license_texts, and the notices, which are whole texts of their own."""
    out = {name: [text] for name, text in NOTICES.items()}
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        name = file.stem.removesuffix("-Regents")
        out.setdefault(name, []).extend(wordings(name, file.read_text(encoding="utf-8")))
    return out


def one_spelling(text):
    for a, b in SPELLINGS.items():
        text = F.regexp_replace(text, a, b)
    return text


def canonical(text):
    """Column: a text in lower case without copyright statements and punctuation, in one spelling, with single blanks; letters of all scripts stay."""
    out = F.lower(F.regexp_replace(text, STATEMENT, " "))
    return one_spelling(F.trim(F.regexp_replace(out, r"[^\p{L}\p{M}\p{N}]+", " ")))


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, license_id): whole texts against known digests, license_id null where there is none.

    Null texts count as empty; a text of nothing but punctuation has no license; repeated rows each get a row; an empty table gives an empty
    result; other columns are left out. The catalogue is in the driver's memory, so its broadcast is bounded by it; of texts with one digest the first name counts.
    """
    pairs = [(name, body) for name, bodies in sorted((catalogue() if texts is None else texts).items()) for body in bodies]
    known = docs.sparkSession.createDataFrame(pairs, "name string, body string")
    known = known.select(F.sha2(canonical(F.col("body")), 256).alias("__known"), "name").groupBy("__known").agg(F.min("name").alias("license_id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"))
    return rows.join(F.broadcast(known), F.col("digest") == F.col("__known"), "left").select("doc_id", "digest", "license_id")
