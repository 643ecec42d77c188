"""Quality rules, line first.

Every line is judged on its own (punctuation, navigation, boilerplate); failing
lines are removed; a document that loses too much of its text is rejected.

Defined cases: a null or empty text has no words and so fails the word minimum;
lines without a word are neutral; repeated documents get equal rows; other
columns of the input are passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows, rewrite_texts

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_lines_removed bigint, "
    "n_words_removed bigint, clean_text string"
)

# What the line rules look for.
SYMBOLS = "#*$%&|<>"
MARKS = "#*$%&|<>{}~^\\!"
SEPARATORS = {"|", ">", ">>", "»", "›", "•", "·", "::", "/"}
TERMINAL = tuple(".!?…:;,\"')]”’»。！？")
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies",
    "accept cookies", "click here", "subscribe now", "sign up for", "javascript is", "enable javascript",
    "lorem ipsum", "©", "(c) copyright",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    #: A text fails when more than this share (%) of its words lies in repeated windows.
    max_repeat_percent: int = 50
    #: A line fails when marks exceed this share (%) of its word characters.
    max_mark_percent: int = 10
    #: A line fails when separators reach this share (%) of its words.
    max_separator_percent: int = 20
    #: A line of so few words without closing punctuation is a menu entry.
    menu_words: int = 3
    #: A document fails when more than this share (%) of its words is removed.
    max_removed_percent: int = 30


def words_of(text: str) -> list[bytes]:
    """Words are runs of anything but space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = dict(zip(dict.fromkeys(words), range(n)))
    code = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    k = len(ids)
    if k == n:
        return 0
    if k < 2_000_000:
        keys = (code[:-2] * k + code[1:-1]) * k + code[2:]
    else:
        _, pairs = np.unique(code[:-2] * k + code[1:-1], return_inverse=True)
        keys = pairs.astype(np.int64) * k + code[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def count(text: str, marks: str) -> int:
    return sum(map(text.count, marks))


def line_fails(line: str, n_words: int, rules: Rules) -> bool:
    if n_words <= rules.menu_words and not line.rstrip().endswith(TERMINAL):
        return True
    if 100 * count(line, MARKS) > rules.max_mark_percent * (len(line) - count(line, WHITE)):
        return True
    separators = sum(w in SEPARATORS for w in SPLIT.split(line))
    if 100 * separators >= rules.max_separator_percent * n_words:
        return True
    lower = line.lower()
    return any(p in lower for p in BOILERPLATE)


WHITE = " \t\n\v\f\r"
SPLIT = re.compile(r"[ \t-\r]+")


def judge(text: str | None, rules: Rules = Rules()) -> tuple:
    """The row of one document, without its id."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    lower = text.lower()
    #: Most texts hold nothing that a rule looks for but menu entries.
    plain = not count(text, MARKS) and not any(s in text for s in SEPARATORS) and not any(p in lower for p in BOILERPLATE)
    seen: set[str] = set()
    dups = removed_lines = removed_words = 0
    kept = []
    for line in text.split("\n"):
        own = len(words_of(line))
        if not own:
            kept.append(line)
            continue
        if line in seen:
            dups += 1
        else:
            seen.add(line)
        if (own <= rules.menu_words or not plain) and line_fails(line, own, rules):
            removed_lines += 1
            removed_words += own
        else:
            kept.append(line)
    repeat = repeated_words(words)
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    good = not failed and 100 * removed_words <= rules.max_removed_percent * n
    return n, len(text) - count(text, WHITE), count(text, SYMBOLS), dups, repeat, failed, good, removed_lines, removed_words, "\n".join(kept)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: counts, verdict and the text without its failing lines."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = SCHEMA if with_text else SCHEMA.replace(", clean_text string", "")

    def run(ids: list, texts: list) -> dict[str, list]:
        rows = [judge(t, rules) for t in texts]
        out = {"doc_id": ids} | {c: [r[i] for r in rows] for i, c in enumerate(names[1:])}
        if not with_text:
            del out["clean_text"]
        return out

    return map_rows(docs, [id_col, text_col], run, schema)


def clean_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The kept documents with the same columns, their failing lines removed."""

    def cleaned(text: str | None) -> str | None:
        row = judge(text, rules)
        return row[9] if row[6] else None

    return rewrite_texts(docs, cleaned, lambda text: text is not None)


#: The same in DuckDB, with the default rules and without the cleaned text.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), g AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS k FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i FROM g WHERE k IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY doc_id, k) > 1
), r AS (
  SELECT doc_id, COUNT(DISTINCT i + s) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), m AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         length(line) - length(regexp_replace(line, '[#*$%&|<>{}~^\\!]', '', 'g')) AS marks, lower(line) AS low FROM l
), f AS (
  SELECT doc_id, line, len(w) AS n,
         (len(w) <= 3 AND NOT regexp_matches(line, '[.!?…:;,"'')\]”’»。！？]\s*$')) OR 100 * marks > 10 * chars
         OR 100 * len(list_filter(w, lambda x: x IN ('|', '>', '>>', '»', '›', '•', '·', '::', '/'))) >= 20 * len(w) OR (PHRASES) AS fails
  FROM m WHERE len(w) > 0
), a AS (
  SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS dups, CAST(SUM(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS gone, CAST(SUM(CASE WHEN fails THEN n ELSE 0 END) AS BIGINT) AS words_gone FROM f GROUP BY doc_id
), c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, COALESCE(dups, 0) AS n_dup_lines, COALESCE(r.n, 0) AS n_repeat_words,
         COALESCE(gone, 0) AS n_lines_removed, COALESCE(words_gone, 0) AS n_words_removed
  FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_removed <= 30 * n_words AS kept, n_lines_removed, n_words_removed
FROM c
""".replace("PHRASES", " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE))
