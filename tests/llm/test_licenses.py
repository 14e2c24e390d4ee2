import random

from tessella.llm.licenses import TEMPLATES, scan_licenses

from .test_contamination import words

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def test_phrases_against_brute_force(docs, corpus):
    rows = scan_licenses(docs).collect()
    assert len(rows) == len(corpus)
    texts = {i: t for i, t, _ in corpus}
    found = 0
    for r in rows:
        w = words(texts[r.doc_id])
        want = sorted((label, i) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert r.n_words == len(w) and sorted((p.label, p.start) for p in r.places or []) == want
        found += len(want)
    assert found >= 3


def slow_spans(text, templates):
    """The spans by their definition, in plain Python: merged diagonals, parted at jumps and holes, of enough votes in order."""
    w, out = words(text), []
    for label, template in templates:
        t = template.split()
        votes = [(p, a) for p in range(len(w) - 2) for a in range(len(t) - 2) if w[p : p + 3] == t[a : a + 3]]
        merged, last = {}, None
        for n, d in enumerate(sorted({p - a for p, a in votes})):
            merged[d] = merged[last] if last is not None and d - last <= 3 else n
            last = d
        for group in set(merged.values()):
            parts = []
            for p, a in sorted(v for v in votes if merged[v[0] - v[1]] == group):
                if not parts or p - parts[-1][-1][0] > 6 or abs((p - a) - (parts[-1][-1][0] - parts[-1][-1][1])) > 3:
                    parts.append([])
                parts[-1].append((p, a))
            for part in parts:
                n, most = 0, -1
                for _, a in part:
                    n, most = n + (a > most), max(a, most)
                start, end = part[0][0], part[-1][0] + 3
                if n / max(len(t) - 2, end - start - 2) >= 0.8:
                    out.append((label, start, end))
    return sorted(out)


def test_spans_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["this is free filler0 is free and filler1 free and unencumbered filler2 and unencumbered software filler3 unencumbered software released filler4 software released into filler5 released into the filler6 into the public filler7 the public domain"]
    for _ in range(250):
        w = " ".join(rng.choice(TEMPLATES)[1] for _ in range(rng.randrange(1, 3))).split()
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(0, 3)] = rng.choice([[], ["new"], ["two", "more"], w[i : i + 4], ["x"] * 9])
        texts.append(" ".join(["the"] * rng.randrange(3) + w + ["of the"]))
    got = {r.doc_id: sorted((s.label, s.start, s.end) for s in r.spans or []) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: slow_spans(t, TEMPLATES) for i, t in enumerate(texts)}
    assert got[0] == [] and sum(bool(v) for v in got.values()) > 100 and any(not v for v in got.values())


def test_templates_survive_small_changes(spark):
    label, text = TEMPLATES[0]
    w = text.split()
    changed = [" ".join(w), " ".join(w[:9] + ["extra"] + w[9:]), " ".join(w[:9] + w[10:]), " ".join(w[:6]), "filler " * 30 + text.upper().replace(" ", "-- ")]
    rows = scan_licenses(spark.createDataFrame(list(enumerate(changed)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(s.label, s.start, s.end) for s in r.spans or []] for r in rows}
    assert got == {0: [(label, 0, len(w))], 1: [(label, 0, len(w) + 1)], 2: [(label, 0, len(w) - 1)], 3: [], 4: [(label, 30, 30 + len(w))]}


def test_defined_results(spark, empty):
    assert scan_licenses(empty).count() == 0
    text = "under the mit license under the mit license"
    rows = scan_licenses(spark.createDataFrame([(1, text), (1, text), (None, None), (2, "a b"), (3, "cc by nc")], "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_words, [(p.label, p.start) for p in r.places or []]) for r in rows)
    assert got == [(0, 0, []), (1, 8, [("mit", 0), ("mit", 4)]), (1, 8, [("mit", 0), ("mit", 4)]), (2, 2, []), (3, 3, [("cc-by-nc", 0)])]
    own = scan_licenses(spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string"), [("x", "beta gamma delta")], {}).collect()
    assert own[0].spans[0].label == "x" and not own[0].places
