"""Filter audit, source mixing and target resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tallyroll.llm import audit, common, mixing, resample

DOCS = "doc_id long, text string, lang string, source string, size string, rank string, part string, _text string, _id string, _row string, _group string"
LABELS = "doc_id long, quality int, toxic int, part string"


@pytest.fixture(scope="module")
def session(spark):
    return common.prepare(spark)


def table(session, rows, schema=DOCS, parts=5):
    width = len(schema.split(","))
    return session.createDataFrame([(*r, *["x"] * (width - len(r))) for r in rows], schema).repartition(parts)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


# ---- filter audit ----------------------------------------------------------------------------------


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang, *_ in docs:
        text, w = text or "", words_of(text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        rows.append((lang or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left, gone = [r for r in left if f not in r[1]], gone + here
                unique = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, "".join(order), step] = [f, len(left), len(here), redundant, unique, sum(r[2] for r in here), sum(r[3] for r in here)]
                shares[part, f] += len(here)
    return {k: (*v, shares[k[0], v[0]]) for k, v in out.items()}


def audited(session, docs, labels):
    counts, names = audit.patterns(table(session, docs), table(session, labels, LABELS, 2))
    rows = audit.interactions(counts, names).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {tuple(r)[:3]: tuple(r)[3:] for r in rows}


def some_texts(rnd):
    long = " ".join(f"w{i}" for i in range(130))
    return [None, "", "short", long, long.upper(), f"{long} #", "same " * 120, "SAME " * 120, f"{long}\x0b{long}", "é " * 99 + "|", " ".join("ab" * 60)] + [
        " ".join(rnd.choice("abcdefgHIJ") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 200))) for _ in range(15)
    ]


def test_audit_equals_every_order_done_one_by_one(session):
    rnd = random.Random(3)
    texts = some_texts(rnd)
    docs = [(rnd.choice([None, *range(90)]), rnd.choice(texts), rnd.choice([None, "", "en", "de", "x y"])) for _ in range(400)]
    docs += docs[:40] + [(7, "short", "en")] * 300
    labels = [(rnd.choice([None, *range(120)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(150)]
    assert audited(session, docs, labels) == plain_audit(docs, labels)


def test_audit_without_rows_labels_or_failures(session):
    assert audited(session, [], []) == {}
    clean = " ".join(f"w{i}" for i in range(130))
    docs = [(1, clean, "en"), (1, clean, None)]
    found = audited(session, docs, [])
    assert found == plain_audit(docs, []) and len(found) == 1200
    assert all(v[1] == 1 and not any(v[2:]) for v in found.values())


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 5), st.data())
def test_least_squares_gives_the_mean_over_orders(n, data):
    removed = [0] + data.draw(st.lists(st.integers(0, 10**15), min_size=2**n - 1, max_size=2**n - 1))
    want = [Fraction(0)] * n
    for order in itertools.permutations(range(n)):
        s = 0
        for i in order:
            want[i] += Fraction(removed[s | 1 << i] - removed[s], math.factorial(n))
            s |= 1 << i
    assert audit.shapley(removed, n) == want


# ---- mixing ----------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Clamp one after the other, by how soon a source fills."""
    named = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    left, rest, out = Fraction(sum(sizes.values())), sum(weight.values()), {}
    for s in sorted(named, key=lambda s: Fraction(sizes[s] * epochs, weight[s])):
        out[s] = min(Fraction(sizes[s] * epochs), left * weight[s] / rest if rest else Fraction(0))
        left -= out[s]
        rest -= weight[s]
    return out


def mixed(session, docs, parts=5, **options):
    frame = mixing.mix(table(session, docs, parts=parts), **options)
    assert len(set(frame.columns)) == len(frame.columns)
    return frame, [r.asDict() for r in frame.collect()]


def check_mix(docs, rows):
    sizes, taken = Counter(), Counter()
    for _, text, _, source in docs:
        sizes[source] += len(words_of(text))
    want = plain_targets(sizes)
    for r in rows:
        assert r["size"] == len(words_of(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]), rel=1e-12)
        assert r["taken"] == r["repeats"] * r["size"] + r["part_words"] <= 3 * r["size"] and r["part_words"] >= 0
        assert r["taken"] >= int(want[r["source"]] / max(sizes[r["source"]], 1)) * r["size"]
        taken[r["source"]] += r["taken"]
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(d[:2] for d in docs)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= Fraction(1, 2) + Fraction(1, 10**6)


def make_docs(seed, n=600):
    rnd = random.Random(seed)
    sources = [None, "", "a", "B", "é", "z", "\U0001f600", "￮"]
    texts = [None, "", "  \n", *["w " * k for k in (1, 1, 2, 5, 30, 4000)]]
    return [(rnd.choice([None, i, i, i]), rnd.choice(texts), "en", rnd.choices(sources, [1, 1, 1, 1, 1, 1, 1, 20])[0]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets_to_the_word(session, monkeypatch, seed):
    docs = make_docs(seed) + [(None, "one", "en", "hot")] * 500 + [(1, "w " * 9, "en", "rare")]
    _, rows = mixed(session, docs)
    check_mix(docs, rows)
    monkeypatch.setattr(common, "GROUP_ROWS", 0)  # groups are not broadcast
    _, again = mixed(session, docs, parts=3)
    key = lambda r: repr((r["doc_id"], r["text"], r["source"], r["taken"]))
    assert sorted(rows, key=key) == sorted(again, key=key)


def test_mix_of_one_source_and_of_nothing(session):
    docs = [(i, "w " * i, "en", "only") for i in range(20)]
    check_mix(docs, mixed(session, docs)[1])
    assert all(r["taken"] == r["size"] for r in mixed(session, docs)[1])
    assert mixed(session, [])[1] == []
    blank = [(1, None, "en", None), (2, " ", "en", "a")]
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed(session, blank)[1])


def test_mixed_corpus_holds_the_words_that_were_taken(session):
    docs = make_docs(9, 200)
    frame, rows = mixed(session, docs, keep=["doc_id", "text", "source"])
    found, want = Counter(), Counter()
    for r in mixing.copies(frame).collect():
        found[r["doc_id"], r["source"], r["size"]] += len(words_of(r["text"]))
    for r in rows:
        want[r["doc_id"], r["source"], r["size"]] += r["taken"]
    assert found == +want


# ---- resampling ------------------------------------------------------------------------------------


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return w, [zlib.crc32(f.encode()) % 10000 for f in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    for d in docs:
        s.update(plain_features(d[1])[1])
    for _, text in target:
        t.update(plain_features(text)[1])
    total, wanted = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (wanted + 10000))))
    rows = []
    for d in docs:
        w, f = plain_features(d[1])
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        rows.append([d[0], len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    drawn = [tuple([*r, k]) for k, r in enumerate(able[: 25 * len(able) // 100], 1)]
    return Counter(drawn) + Counter((*r, None) for r in [*able[25 * len(able) // 100 :], *[r for r in rows if r[1] < 20]])


def resampled(session, docs, target):
    schema = "item_id long, text string, bucket string"
    frame = resample.resample(table(session, docs), table(session, target, schema, 2), keep=["doc_id", "size", "rank"])
    assert frame.columns == ["doc_id", "size", *resample.RESULTS]
    return Counter(tuple(r)[:1] + tuple(r)[2:] for r in frame.collect())


def odd_texts(rnd, n):
    words = ["the", "The", "tHe", "é", "ÉA", "x9", "日本", "İ", "w" * 64, "w" * 65, "V" * 3000, "a", "b", "c d", "K"]
    gaps = [" ", "\n", "\n\n", "-", " \n- ", "\r\n", "\x00", "\n\x0b\n", "\x7f", "[", "`"]
    made = ["".join(rnd.choice(words) + rnd.choice(gaps) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return [None, "", "\n", "...", "a", "\na\n", "same line\nsame line\nsame line", *made]


def test_resampling_equals_a_plain_version(session):
    rnd = random.Random(5)
    texts = odd_texts(rnd, 60)
    docs = [(rnd.choice([None, i, i, i]), rnd.choice(texts)) for i in range(300)] + [(5, texts[-1])] * 30 + [(6, "one line of all\n" * 40)] * 200
    target = [(i, rnd.choice(texts)) for i in range(12)] + [(99, "the a b the a b")]
    assert resampled(session, docs, target) == plain_resample(docs, target)


def test_resampling_without_documents_target_or_words(session):
    assert not resampled(session, [], [(1, "a b")])
    docs = [(1, None), (2, "..."), (3, "a " * 30), (4, "b " * 30)]
    assert resampled(session, docs, []) == plain_resample(docs, [])


def test_segments_hold_every_feature_once(session):
    rnd = random.Random(6)
    texts = [t for t in odd_texts(rnd, 80)] * 2
    found = resample.bucket_counts(table(session, [(i, t) for i, t in enumerate(texts)]).selectExpr("text as _text"), 10000).collect()
    assert dict(map(tuple, found)) == Counter(b for t in texts for b in plain_features(t)[1])


def test_batches_cut_anywhere_give_the_same_features():
    rnd = random.Random(7)
    texts = odd_texts(rnd, 40) + ["x", "y", "", "z" * 70, None]
    whole = resample.Features(pa.array(texts, pa.string()), 10000)
    parts = [resample.Features(pa.array(texts, pa.string()).slice(i, 7), 10000) for i in range(0, len(texts), 7)]
    assert np.array_equal(whole.single, np.concatenate([p.single for p in parts]))
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[i] = Counter(plain_features(t)[1])
    for i in range(len(texts)):
        here = whole.text == i
        assert Counter([*whole.single[here].tolist(), *whole.pair[here & whole.paired].tolist()]) == want[i]
