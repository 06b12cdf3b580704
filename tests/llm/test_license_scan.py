import hashlib

import numpy as np

from quarry.llm import license_scan
from quarry.llm.queries import op4_license_scan
from tests.conftest import SF


def brute(docs, window):
    """id -> (words, removed, kept words joined)."""
    words, first = [(t or "").encode().split() for _, t in docs], {}
    for (d, _), w in zip(docs, words):
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if d is not None and first.get(key, d) >= d:
                first[key] = d
    out = []
    for (d, _), w in zip(docs, words):
        gone = set()
        for s in range(len(w) - window + 1):
            if d is not None and first[tuple(w[s : s + window])] < d:
                gone.update(range(s, s + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d if d is not None else -1, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_license_scan(spark, SF).collect())) == brute(docs, 50)


def test_planted_passages_buckets_and_hot_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 50, n)]
    passage, rows = text(40), []
    for k in range(30):
        rows.append((k, "  ".join(text(int(rng.integers(0, 20))) + passage[int(rng.integers(0, 8)) : 30 + int(rng.integers(0, 10))] + text(9))))
    same = " \n".join(text(60))
    rows += [(100, same), (101, same), (101, same + " w"), (None, same), (7, same.replace("\n", "\t")), (200, None), (201, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: got(license_scan.remove_copied(table, window=12, gram=3))
    expected = brute(rows, 12)
    assert run() == expected
    monkeypatch.setattr(license_scan, "BUCKET_RUNS", 5)
    monkeypatch.setattr(license_scan, "HOT_CONTEXTS", 1)
    assert run() == expected


def test_odd_rows(spark):
    table = spark.createDataFrame([(1, "a", "x", 3), (1, None, None, None)], "doc_id long, text string, row string, spans int")
    out = license_scan.remove_copied(table)
    assert got(out) == [(1, 0, 0, hashlib.sha256(b"").hexdigest()), (1, 1, 0, hashlib.sha256(b"a").hexdigest())]
    assert out.columns == ["doc_id", "text", "row", "kept", "n_words", "n_removed", "spans"]
    assert license_scan.remove_copied(table.limit(0)).count() == 0


def test_scan_reports_coverage_and_spans(spark):
    license_text = "permission is hereby granted free of charge to any person obtaining a copy of this software and its files"
    changed = license_text.replace("hereby granted", "now given").replace("obtaining", "who gets hold of")
    docs = spark.createDataFrame(
        [(1, f"some code {license_text} more code"), (2, f"x {changed} y"), (3, "nothing of the kind stands in this text at all"), (4, None)],
        "doc_id long, text string",
    )
    templates = spark.createDataFrame([(9, license_text), (8, "too short"), (7, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs, templates).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].coverage == 1.0 and [tuple(s) for s in rows[1].spans] == [(2, 21)]
    assert rows[2].n_matched == 16 and rows[2].spans[0].a == 1
    assert license_scan.scan(docs, templates.limit(0)).count() == 0


def test_scan_takes_every_copy_and_every_part():
    rng = np.random.default_rng(11)
    text = lambda n, tag: [f"{tag}{x}" for x in rng.integers(0, 10**6, n)]
    template, small = text(120, "t"), text(12, "s")
    index = license_scan.Index([("big", " ".join(template)), ("small", " ".join(small))], 8, 4)
    told = lambda words: {k: (c, n, s) for k, c, n, s in license_scan.matches(index, " ".join(words), 16, 0.5)}
    # a second copy, far away and back to back
    assert told(text(30, "a") + template + text(200, "b") + template)["big"] == (1.0, 240, [(30, 150), (350, 470)])
    assert told(text(30, "a") + small + text(3, "b") + small)["small"] == (1.0, 24, [(30, 42), (45, 57)])
    # split by two insertions into parts that are each under half of the template
    split = template[:40] + text(60, "a") + template[40:80] + text(60, "b") + template[80:]
    assert told(split)["big"] == (1.0, 120, [(0, 40), (100, 140), (200, 240)])
    # strays of a few words don't make a template
    stray = [w for k in range(0, 40, 4) for w in template[k : k + 4] + text(300, "c")]
    assert told(stray) == {}
