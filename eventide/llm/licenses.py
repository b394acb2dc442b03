"""License scan: Aho-Corasick over words, shunting-yard over tag expressions.

One automaton holds every notice phrase and the words of the identifier tags;
it runs over the words of the text (lower-cased A-Z, one space between words),
so a phrase is found wherever its words stand consecutively.  A text with a
tag is searched once more, by a second automaton over its raw lower-cased
bytes, for the tag as written; the expression after it (to the end of the
line) goes through a shunting-yard parser (``with`` binds before ``and``
before ``or``) and is evaluated on the way.

Evaluation: a licence has a grade from 0 (all rights reserved) to 1 (no
condition beyond attribution).  ``or`` takes the better grade, ``and`` the worse,
``with`` (an exception) moves the grade a quarter of the way to 1.  A
document's ``score`` is the lowest grade of all that was found in it, and
``UNSTATED`` (0.5) if nothing was.

Edge cases: null and empty texts have no words, no label and score 0.5;
repeated and overlapping places all count; equal rows each get a row; an
expression that doesn't parse is cut at the first token that cannot follow;
unknown identifiers keep their name as a label and get 0.5; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import LOWER, PLAIN_WORDS, as_bytes, texts

UNSTATED = 0.5

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl-3",
    "mozilla public license version 2 0": "mpl-2",
    "eclipse public license": "epl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution 4 0": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0 universal": "cc0",
    "free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}

# Tags that introduce a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:")

# Identifiers used in expressions, and their labels.
IDENTIFIERS = {
    "mit": "mit",
    "apache-2.0": "apache-2",
    "bsd-2-clause": "bsd",
    "bsd-3-clause": "bsd",
    "isc": "isc",
    "zlib": "zlib",
    "unlicense": "unlicense",
    "cc0-1.0": "cc0",
    "cc-by-4.0": "cc-by",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-nd-4.0": "cc-by-nd",
    "mpl-2.0": "mpl-2",
    "epl-2.0": "epl",
    "lgpl-2.1-only": "lgpl",
    "lgpl-2.1-or-later": "lgpl",
    "lgpl-3.0-only": "lgpl",
    "lgpl-3.0-or-later": "lgpl",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3",
    "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3",
    "gpl-2.0": "gpl-2",
    "gpl-3.0": "gpl-3",
    "lgpl-2.1": "lgpl",
    "lgpl-3.0": "lgpl",
    "agpl-3.0": "agpl-3",
}

# Grades by label; a label that isn't listed has grade 0.5.
GRADES = {
    "mit": 1.0, "apache-2": 1.0, "bsd": 1.0, "isc": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc-by": 1.0,
    "mpl-2": 0.7, "epl": 0.7, "lgpl": 0.7, "cc-by-sa": 0.6,
    "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}

TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9.+-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}

RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "expressions array<string>")


def automaton(phrases):
    import ahocorasick
    a = ahocorasick.Automaton()
    for p in phrases:
        a.add_word(p, p)
    a.make_automaton()
    return a


def evaluate(text: str) -> tuple[str, set[str], float] | None:
    """Read one expression by a shunting yard: its canonical form, its labels
    and its grade; None if no licence starts the text."""
    values: list[tuple[str, set[str], float]] = []
    waiting: list[str] = []
    depth, at, operand_next, seen = 0, 0, True, 0

    def reduce_top() -> None:
        op = waiting.pop()
        right, left = values.pop(), values.pop()
        if op == "with":
            values.append((f"{left[0]} WITH {right[0]}", left[1], left[2] + (1 - left[2]) / 4))
        else:
            grade = max(left[2], right[2]) if op == "or" else min(left[2], right[2])
            values.append((f"({left[0]} {op.upper()} {right[0]})", left[1] | right[1], grade))

    while m := TOKEN.match(text, at):
        t = m[1]
        if operand_next:
            if t == "(":
                waiting.append(t)
                depth += 1
            elif t == ")" or t in BINDS:
                break
            else:
                label = IDENTIFIERS.get(t.rstrip("+"), t)
                values.append((t, {label}, GRADES.get(label, UNSTATED)))
                operand_next, seen = False, m.end()
        elif t == ")":
            if not depth:
                break
            while waiting[-1] != "(":
                reduce_top()
            waiting.pop()
            depth -= 1
            seen = m.end()
        elif t in BINDS:
            follows = TOKEN.match(text, m.end())
            if not follows or follows[1] == ")" or follows[1] in BINDS or t == "with" and follows[1] == "(":
                break
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                reduce_top()
            waiting.append(t)
            operand_next = True
        else:
            break
        at = m.end()
    if not seen:
        return None
    while operand_next and waiting:  # what has no right operand goes, and the brackets opened after it
        operand_next = waiting.pop() == "("
    while waiting:
        if waiting[-1] == "(":
            waiting.pop()
        else:
            reduce_top()
    form = values[-1][0]
    return form[1:-1] if form.startswith("(") and form.endswith(")") else form, values[-1][1], values[-1][2]


class Scanner:
    def __init__(self) -> None:
        self.tags = automaton(TAGS)
        self.tag_words = {f" {b' '.join(words(t.encode())).decode()} " for t in TAGS}
        self.base = {f" {p} ": label for p, label in BASE_PHRASES.items()}
        self.notices = {f" {p} ": label for p, label in NOTICE_PHRASES.items()}
        self.phrases = automaton([*self.base, *self.notices, *self.tag_words])

    def expressions(self, text: bytes) -> list[tuple[str, set[str], float]]:
        raw = text.translate(LOWER).decode("utf-8", "replace")
        found = []
        for end, _ in self.tags.iter(raw):
            stop = raw.find("\n", end)
            value = evaluate(raw[end + 1:stop if stop >= 0 else len(raw)])
            if value:
                found.append(value)
        return found

    def scan(self, text: bytes | None) -> tuple:
        ws = words(text)
        places, base, labels, grades, said = [], set(), set(), [], []
        if ws:
            plain = f" {b' '.join(ws).decode('utf-8', 'replace')} "
            tagged = False
            for end, phrase in self.phrases.iter(plain):
                if label := self.base.get(phrase):
                    places.append(end + 1 - len(phrase))
                    base.add(label)
                elif not (label := self.notices.get(phrase)):
                    tagged = True
                    continue
                labels.add(label)
                grades.append(GRADES[label])
            if tagged:
                for form, of, grade in self.expressions(text):
                    said.append(form)
                    labels |= of
                    grades.append(grade)
        first, last = (plain.count(" ", 0, x) if places else None for x in (min(places, default=0), max(places, default=0)))
        return (len(ws), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)),
                min(grades, default=UNSTATED), said)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN_WORDS).split() if text else []


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``doc_id`` and the columns of ``RESULT``; a
    map over whole texts without a shuffle."""
    body = as_bytes(texts(docs, id_col, text_col))
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def scan(batches):
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(x.as_py()) for x in batch.column(1)]
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                                             names=["doc_id", *names])

    return body.mapInArrow(scan, f"doc_id {dict(body.dtypes)['doc_id']}, {RESULT}").withColumn(
        "expressions", F.array_join("expressions", "; "))
