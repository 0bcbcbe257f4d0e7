"""op2 and op7 against brute force."""

import hashlib
import random
import re

from corpusloom.llm import licenses, lines
from tests.llm.cases import SCHEMA, rows
from tests.llm.test_rowwise import _bag


def _words(text):
    return re.findall(r"[^\W_]+", text.lower())


def _lcs_length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = best
        best = [0]
        for j, y in enumerate(b):
            best.append(last[j] + 1 if x == y else max(best[j], last[j + 1]))
    return best[-1]


INDEX = licenses.Index(licenses.TEMPLATES)


def _filler(r, n):
    return " ".join(r.choice(["the", "software", "zeta", "licensed", "under", "work", "lorem", "ipsum"]) for _ in range(n))


def _checked(text):
    """scan(), with each match held to its own words: apart, in order, and as well covered as it says."""
    found = licenses.scan(text, INDEX)
    for name, start, end, coverage in found:
        want = _words(licenses.TEMPLATES[name])
        own = _words(text[start:end])
        assert coverage >= licenses.LEAST and round(coverage * len(want)) <= _lcs_length(want, own) and own[0] in want and own[-1] in want
    assert all(x[2] <= y[1] for x, y in zip(found, found[1:]))
    return found


def test_licenses_as_they_stand():
    """Verbatim templates are found in full, at their place, but where a longer one that holds them stands."""
    r = random.Random(1)
    for name, template in licenses.TEMPLATES.items():
        head = _filler(r, 20) + " zeta.\n "
        text = f"{head}{template.upper()} zeta {_filler(r, 9)}"
        found = _checked(text)
        inside = [n for n, t in licenses.TEMPLATES.items() if n != name and f" {' '.join(_words(template))} " in f" {' '.join(_words(t))} "]
        assert [f[0] for f in found if f[0] == name or f[0] in inside], name
        if not inside:
            (own,) = [f for f in found if f[0] == name]
            assert own[1] == len(head) and own[3] == 1.0 and _words(text[own[1] : own[2]]) == _words(template)
    assert licenses.scan("", INDEX) == [] and licenses.scan("zeta lorem " * 300, INDEX) == []


def test_licenses_twice():
    for name in ("All-rights-reserved", "CC-BY-4.0-line", "MIT-line", "ISC"):
        t = licenses.TEMPLATES[name]
        assert [f[0] for f in _checked(f"{t} {t}")] == [name, name]
        assert [f[0] for f in _checked(f"{t} {t} zeta {t}")] == [name] * 3
    second = "Licensed under CC BY 4.0. Under CC BY 4.0."  # its first word is gone
    assert [(f[0], f[3]) for f in _checked(second)] == [("CC-BY-4.0-line", 1.0), ("CC-BY-4.0-line", round(5 / 6, 4))]


def test_licenses_edited():
    r = random.Random(2)
    for name, template in licenses.TEMPLATES.items():
        words = template.split()
        if len(_words(template)) > 40:
            edited = [w for i, w in enumerate(words) if i % 14 != 7]
            edited[20:20] = ["some", "added", "words"]
            (found,) = _checked(f"{_filler(r, 5)} {' '.join(edited)} {_filler(r, 5)}")
            assert found[0] == name and 0.88 < found[3] < 1.0
        elif len(_words(template)) >= 5:  # any one word of a short notice
            plain = _words(template)
            for i in range(len(plain)):
                found = _checked(" ".join(["zeta", *plain[:i], "quux", *plain[i + 1 :], "zeta"]))
                assert [f for f in found if f[0] == name or f[3] >= 1 - 1 / len(plain) - 1e-3], (name, i)
    for n in range(1, 60):
        lost = n - -(-n * 8 // 10)
        assert licenses.sure_run(n, 0.8) == -(-(n - lost) // (lost + 1)) >= 1


def test_many_licenses_in_one_text():
    text = " ".join(f"{licenses.TEMPLATES['MIT-line']} zeta {i}" for i in range(4000))
    found = licenses.scan(text, INDEX)
    assert len(found) == 4000 and {f[0] for f in found} == {"MIT-line"}


def test_license_frame(spark):
    docs = spark.createDataFrame([*rows(), (7000, "x. " + licenses.TEMPLATES["MIT"] + " y", None, None, None, None, None, None, None, None)], SCHEMA)
    found = {r.doc_id: r.matches for r in licenses.find(docs).collect()}
    assert [m["license"] for m in found[7000]] == ["MIT"] and found[7000][0]["start"] == 3
    assert licenses.find(docs).count() == docs.count() and licenses.find(docs.limit(0)).count() == 0
    assert [m["license"] for m in licenses.find(docs, templates={"two": "y1 y2"}).first().matches] == []


def test_licenses_of_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = licenses.op2_license_scan(spark, small).collect()
    assert any(r.n_licenses for r in found) and len(found) == len(text)
    for r in found:
        marks = [m for m in text[r.doc_id].split("\n") if "icensed" in m or "rights reserved" in m or "MIT License" in m]
        assert r.n_licenses == len(marks) == len(_checked(text[r.doc_id]))


def _lines(text):
    return [x.strip(" \t\r\x0b\x0c") for x in text.split("\n")] if text else []


def _brute(data):
    """Every pair of documents and of lines: common runs of three lines or 40 bytes, without hashes."""
    out = []
    for key, text in data:
        own, gone = _lines(text), set()
        for other, earlier in data:
            if key is None or other is None or other >= key:
                continue
            theirs = _lines(earlier)
            for i in range(len(theirs)):
                for j in range(len(own)):
                    n = 0
                    while i + n < len(theirs) and j + n < len(own) and own[j + n] and theirs[i + n] == own[j + n]:
                        n += 1
                    if n >= 3 or sum(len(x.encode()) for x in own[j : j + n]) >= 40:
                        gone.update(range(j, j + n))
        parts = text.split("\n") if text else []
        kept = "\n".join(x for i, x in enumerate(parts) if i not in gone)
        out.append((key, len(parts), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_patience():
    assert lines.patience([]) == [] and lines.patience([(0, 5), (1, 3), (2, 4), (3, 9)]) == [(1, 3), (2, 4), (3, 9)]
    r = random.Random(3)
    for _ in range(100):
        points = list({(i, r.randint(0, 12)) for i in range(r.randint(0, 9))})
        chain = lines.patience(points)
        assert all(p in points for p in chain) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))
        best = [0]
        for k, p in enumerate(sorted(points)):
            best.append(1 + max([n for n, q in zip(best[1:], sorted(points)) if q[0] < p[0] and q[1] < p[1]], default=0))
        assert len(chain) == max(best)


def _pages():
    r = random.Random(8)
    boiler = ["Home | About | Contact us", "Copyright by the people who wrote it", "short"]
    shared = [[f"shared passage {p} line {i} of it" for i in range(8)] for p in range(5)]
    data = []
    for i in range(60):
        text = boiler[:1] + [f"own line {i} {j}" for j in range(r.randint(0, 5))]
        for p in r.sample(shared, r.randint(0, 2)):
            text += p[r.randint(0, 4) :] + ["", f" own tail {r.randint(0, 9)}  "]
        data.append((i, "\n".join(text + boiler[1:])))
    return data + [(100, data[4][1]), data[5], (None, data[5][1]), (101, None), (102, ""), (103, "\n\n\n"), (7, "other text of seven\nHome | About | Contact us"), (104, "\r\n".join(data[3][1].split("\n")))]


def _mixed():
    r = random.Random(9)
    few = [f"line {c} of few" for c in "LMNOPQ"] + ["a line that is long enough to be a block alone", "", "x"]
    mixed = [(5000 + i, "\n".join(r.choice(few) for _ in range(r.randint(1, 12)))) for i in range(60)]
    block = "line with L alone\nline with M alone\nline with N alone"
    alone = [(4000 + i, f"own {i}\n{x}\nend {i}") for i, x in enumerate([*block.split("\n"), block, block])]
    # another order, and more copies than the earliest holder has
    moved = [(1, "B1\nB2\nB3\nA1\nA2\nA3\nA4"), (2, "A1\nA2\nA3\nA4\nown\nB1\nB2\nB3"), (3, "A1\nA2\nA3\nA4\nB1\nB2\nB3"), (4, "B1\nB2\nB3\nz\nB1\nB2\nB3"), (5, "B1\nB2\nB3\ny\nB1\nB2\nB3")]
    return mixed + alone + [(8000 + i, t) for i, t in moved]


def test_line_dedup(spark, tmp_path):
    data = _pages() + _mixed() + [(3000 + i, r[1]) for i, r in enumerate(rows()) if len(r[1] or "") < 5000] + [(4004, None), (8003, "B1\nB2\nB3\nA1")]
    df = spark.createDataFrame([(*x, 5, 6, 7) for x in data], "doc_id long, text string, row int, key int, blocks int").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(x) for x in lines.op7_line_dedup(spark, str(tmp_path)).collect()]
    assert _bag(found) == _bag(_brute(data)) and {x[:3] for x in found} >= {(4004, 5, 3), (8002, 8, 7), (8004, 7, 6)}
    assert lines.deduplicate(df.limit(0)).count() == 0


def test_line_dedup_blocks(spark):
    """Blocks are equal lines of the earlier document; those that are not moved run the same way in both."""
    data = dict(_mixed())
    found = lines.deduplicate(spark.createDataFrame(list(data.items()), "doc_id long, text string")).collect()
    seen = 0
    for r in found:
        for b in r.blocks:
            own, theirs = _lines(data[r.doc_id]), _lines(data[b.earlier])
            assert b.earlier < r.doc_id and own[b["at"] : b["at"] + b.lines] == theirs[b.at_earlier : b.at_earlier + b.lines]
            seen += 1
        for partner in {b.earlier for b in r.blocks}:
            straight = sorted((b["at"], b.at_earlier) for b in r.blocks if b.earlier == partner and not b.moved)
            assert straight == sorted(straight, key=lambda x: x[1])
    by_id = {r.doc_id: r.blocks for r in found}
    assert seen > 20 and sorted((b.at_earlier, b["at"], b.lines, b.moved) for b in by_id[8002]) == [(0, 5, 3, True), (3, 0, 4, False)]


def test_line_dedup_of_single_holders(spark):
    """Six lines that two documents share, each held by one earlier document of its own."""
    six = [f"shared {c} line" for c in "abcdef"]
    data = [(i, f"own {i}\n{six[i]}\nend {i}") for i in range(6)] + [(6, "\n".join(["x", *six])), (7, "\n".join([*six, "y"]))]
    found = {r.doc_id: r.n_removed for r in lines.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found == {**dict.fromkeys(range(7), 0), 7: 6}


def test_line_dedup_of_a_large_group(spark):
    page = "\n".join(f"the same long line number {i}" for i in range(30))
    data = [(i, f"a title of its own {i}\n{page}\nand an end of its own {i}") for i in range(400)] + [(1000 + i, page) for i in range(300)]
    found = lines.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), with_text=True).collect()
    assert sum(r.n_removed == 30 for r in found) == 699 and all(r.doc_id or not r.n_removed for r in found)


def test_line_dedup_oracle(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = [tuple(r) for r in lines.op7_line_dedup(spark, small).collect()]
    assert _bag(found) == _bag(con.sql(lines.OP7_SQL).fetchall()) and any(r[2] for r in found)
