import re

import pytest

from eventide.llm import licenses, registry

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    def places(phrase):
        p = phrase.split()
        return [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]

    at = sorted(i for p in licenses.BASE_PHRASES for i in places(p))
    base = sorted({x for p, x in licenses.BASE_PHRASES.items() if places(p)})
    more = {x for p, x in licenses.NOTICE_PHRASES.items() if places(p)}
    return len(ws), len(at), at[0] if at else None, at[-1] if at else None, ",".join(base), ",".join(sorted({*base, *more}))


def test_whole_table_against_brute_force(spark, real):
    got = {r.doc_id: r for r in registry.op10_license_scan(spark, SF).collect()}
    assert len(got) == len(real[1])
    for i, t, _ in real[1]:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == brute(t)
        assert 0 <= r.score <= 1


def test_odd_rows(make_docs, odd):
    rows = odd + [(80, "UNDER the MIT-License under the mit license; cc by nc by nc cc/by/nc"), (81, "summit license under the mit licenses"),
                  (82, "é cc by nc é apache license,\n version 2.0"), (83, "CC BY NC " * 5000)]
    got = licenses.scan_licenses(make_docs(rows, clash=True)).collect()
    assert sorted(map(repr, ((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in got))) == sorted(
        repr(brute(t)) for _, t in rows)
    assert licenses.scan_licenses(make_docs([])).count() == 0


@pytest.mark.parametrize("text, form, labels, grade", [
    ("mit", "mit", {"mit"}, 1.0),
    ("mit or gpl-3.0-only", "mit OR gpl-3.0-only", {"mit", "gpl-3"}, 1.0),
    ("mit and gpl-3.0-only", "mit AND gpl-3.0-only", {"mit", "gpl-3"}, 0.4),
    ("mit or isc and gpl-2.0-only", "mit OR (isc AND gpl-2.0-only)", {"mit", "isc", "gpl-2"}, 1.0),
    ("(mit or isc) and gpl-2.0-only", "(mit OR isc) AND gpl-2.0-only", {"mit", "isc", "gpl-2"}, 0.4),
    ("gpl-2.0-only with classpath-exception-2.0 and mit", "gpl-2.0-only WITH classpath-exception-2.0 AND mit", {"gpl-2", "mit"}, 0.55),
    ("mit and", "mit", {"mit"}, 1.0),
    ("mit) and isc", "mit", {"mit"}, 1.0),
    ("my-own-1.0 */", "my-own-1.0", {"my-own-1.0"}, 0.5),
    ("((mit", "mit", {"mit"}, 1.0),
])
def test_expressions(text, form, labels, grade):
    got = licenses.evaluate(text)
    assert (got[0], got[1]) == (form, labels) and got[2] == pytest.approx(grade)


@pytest.mark.parametrize("text", ["", "()", "and mit", ") mit", "or"])
def test_no_expression(text):
    assert licenses.evaluate(text) is None


def test_tags_in_documents(make_docs):
    rows = [(1, "# SPDX-License-Identifier: MIT OR\n# GPL-2.0-only"), (2, "x\nSPDX-License-Identifier: (GPL-3.0-only AND\tISC) -->\ny"),
            (3, "spdx license identifier mit")]
    got = {r.doc_id: (r.labels, r.score, r.expressions) for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got == {1: ("mit", 1.0, "mit"), 2: ("gpl-3,isc", 0.4, "gpl-3.0-only AND isc"), 3: ("", 0.5, "")}


def graded(x):
    form, labels, grade = licenses.evaluate(x)
    return form, grade


def test_operators_without_a_right_operand_are_dropped():
    want = ("mit OR gpl-3.0", 1.0)
    for tail in ("", " and (", " and ((", " or", " and", " with", " and (( or", " )"):
        assert graded("mit or gpl-3.0" + tail) == want, tail
    assert graded("(mit or (") == ("mit", 1.0)
    assert graded("gpl-3.0 or (mit and (") == ("gpl-3.0 OR mit", 1.0)
    assert graded("gpl-3.0 and (mit or isc") == ("gpl-3.0 AND (mit OR isc)", 0.4)
    assert licenses.evaluate("( and mit") is None and licenses.evaluate("") is None
