import base64
import hashlib
import math
import random

from tessella.llm.fingerprints import bucket_distances, code_counts, digest, fingerprints, likeness


def slow_digest(data):
    """The digest in plain Python, from its description: (length code, quartile of each of 2,048 buckets)."""
    counts = [0] * 2048

    def add(a, b, c, salt):
        h = ((a << 16 | b << 8 | c) + (salt << 24)) * 0x9E3779B1 % 2**32
        h ^= h >> 15
        counts[h * 0x85EBCA77 % 2**32 >> 21] += 1

    if data:
        b = data + bytes(max(0, 3 - len(data)))
        for i in range(len(b) - 3):
            for salt, (j, k) in enumerate(((1, 2), (1, 3), (2, 3))):
                add(b[i], b[i + j], b[i + k], salt)
        add(*b[-3:], 0)
    ordered = sorted(counts)
    quartiles = [ordered[511], ordered[1023], ordered[1535]]
    return min(255, round(4 * math.log2(1 + len(data)))), [sum(c > q for q in quartiles) for c in counts]


def slow_likeness(a, b):
    far = lambda x, y: 6 if abs(x - y) == 3 else abs(x - y)
    expected = sum(a[1].count(x) * b[1].count(y) * far(x, y) for x in range(4) for y in range(4)) / 2048
    differ = sum(map(far, a[1], b[1]))
    share = differ / expected if expected else float(differ > 0)
    return max(0.0, 1 - share - 0.1 * min(1.0, abs(a[0] - b[0]) / 16))


def unpacked(fingerprint):
    raw = base64.b64decode(fingerprint)
    return raw[0], [b >> s & 3 for b in raw[1:] for s in (6, 4, 2, 0)]


def test_against_brute_force(docs, corpus):
    order = sorted(corpus, key=lambda r: -r[0])
    rows = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(rows) == len(corpus)
    own = {doc: slow_digest((text or "").encode()) for doc, text, _ in corpus}
    for i, (doc, text, _) in enumerate(order):
        text, after, n = text or "", order[(i + 1) % len(order)][1] or "", order[(i + 1) % len(order)][0]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = rows[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert unpacked(r.fingerprint) == own[doc] and unpacked(r.edited_fingerprint) == slow_digest(edited.encode())
        assert abs(r.near_edited - slow_likeness(own[doc], slow_digest(edited.encode()))) < 1e-12
        assert abs(r.near_next - slow_likeness(own[doc], own[n])) < 1e-12


def test_long_texts_are_counted_whole():
    data = random.Random(3).randbytes(600_000)
    raw = digest(data)
    assert (raw[0], [b >> s & 3 for b in raw[1:] for s in (6, 4, 2, 0)]) == slow_digest(data)


def like(a, b):
    return likeness(digest(a.encode()), digest(b.encode()), bucket_distances(), code_counts())


def test_likeness():
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    a, c = letters(4000), letters(4000)
    assert like(a, a) == like("", "") == like("x", "x") == 1 and like(a, "") == 0
    assert 1 > like(a, a[:3600] + letters(400)) > like(a, c) + 0.3 >= 0.3


def test_unrelated_short_texts_are_unlike():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    for n in (1, 3, 5, 10, 40):
        scores = [like(" ".join(rng.sample(words, n)), " ".join(rng.sample(words, n))) for _ in range(60)]
        assert sum(scores) / len(scores) < 0.2, n


def test_nulls_ties_single_and_empty(spark, empty):
    assert fingerprints(empty).count() == 0
    one = fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    odd = spark.createDataFrame([(None, "null id"), (None, None), (1, "x"), (1, "x"), (1, "y"), (2**62, "big"), (-(2**62), "low")], "doc_id long, text string")
    rows = fingerprints(odd).collect()
    assert sorted(r.n_chars for r in rows) == [0, 1, 1, 1, 3, 3, 7]
    big = next(r for r in rows if r.n_chars == 3 and r.doc_id == 2**62)
    assert big.edited_sha256 in {hashlib.sha256(b"bi" + x).hexdigest() for x in (b"x", b"y")}
