"""The filter audit against plain loops over all orders."""

import itertools
import re
from collections import Counter
from fractions import Fraction

import duckdb

from parlance.llm import audit
from parlance.llm import queries as Q


def brute(docs, labels):
    least = {}
    for d, _, t in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = {}
    for d, lang, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        parts.setdefault(lang or "", []).append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        total = Counter()
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                total[f] += len(gone)
                redundant = sum(f in r[0] for r in rows) - len(gone)
                mine.append(((part, "".join(order), step, len(left), len(gone), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)), f))
        out += [(*r, total[f]) for r, f in mine]
    return sorted(out)


def test_awkward_rows(spark):
    prose = " ".join(f"word{i}" for i in range(120))
    docs = [
        (1, "en", prose), (2, "en", prose), (2, "en", prose), (3, "de", prose), (None, "en", prose), (None, None, None), (4, None, ""), (5, "", ""),
        (6, "en", "a " * 400), (7, "en", "a " * 400 + "#"), (8, "fr", "ABC\x0b\x0cDEF \x85 é"), (9, "fr", prose.upper()), (0, "de", prose + " |"), (9, "en", None),
        (10, "en", " ".join(str(i) for i in range(200_000))), (-5, "zz", "&"), (11, "zz", "&"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, 0, 0), (6, 1, 0), (9, 1, 1), (None, 1, 1), (11, None, 1), (99, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, lang string, text string, part string, mask int").repartition(3)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit_filters(frame, told).collect()))
    assert got == brute(docs, labels)
    assert audit.audit_filters(frame.limit(0), told).count() == 0
    none = audit.audit_filters(frame, told.limit(0)).collect()
    assert len(none) == len(got) and not any(r.good_lost or r.toxic_lost for r in none)


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = Q.op11_filter_audit(spark, sf)
    want = con.sql(Q.SQL["op11_filter_audit"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_polynomials():
    poly = audit.removal({0b00: 4, 0b01: 3, 0b11: 2})
    assert [audit.corner(poly, on) for on in range(4)] == [0, 5, 2, 5]
    assert audit.diagonal_integral(audit.derivative(poly, 0)) == 4 and audit.diagonal_integral(audit.derivative(poly, 1)) == 1
    assert audit.diagonal_integral({0b111: 1, 0: 1}) == Fraction(5, 4)
