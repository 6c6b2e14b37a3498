"""Exact, SimHash and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.exact_dedup import build_mph, exact_dedup, look_up
from quarry.llm.near_dups import drop_near_duplicates, near_duplicates
from quarry.llm.simhash import _halves, near_links, segments, shingle_hashes, simhash_components
from quarry.llm.substring_dedup import anchors, remove_repeats, window_classes
from quarry.llm.suffix_array import prefix_classes, suffix_array


def test_mph_is_minimal_and_checks_bytes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    sizes, bits, slots = build_mph(keys)
    assert sorted(slots) == list(range(3000))
    held = b"".join(keys[i] for i in np.argsort(slots))
    assert (look_up(keys, sizes, bits, held) == slots).all()
    other = [hashlib.sha256(f"n{i}".encode()).digest() for i in range(3000)]
    assert (look_up(other, sizes, bits, held) == -1).all()


def test_exact(odd, empty, plain_rows):
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for r in plain_rows:
        groups[digest(r[1])].append(r[0])
    want = Counter()
    for g, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, g) for i in ids)
    assert Counter(map(tuple, exact_dedup(odd, shard_keys=4).collect())) == want
    assert exact_dedup(empty).count() == 0


def _fingerprint(text, words):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(odd, empty, plain_rows):
    fps = [_fingerprint(r[1], 3) for r in plain_rows]
    label = list(range(len(fps)))
    for i in range(len(fps)):
        near = {label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}
        label = [min(near) if x in near else x for x in label]
    least = {k: min((r[0] for r, x in zip(plain_rows, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    want = Counter((r[0], f"{f:016x}", least[k]) for r, f, k in zip(plain_rows, fps, label))
    assert Counter(map(tuple, simhash_components(odd).collect())) == want
    assert simhash_components(empty).count() == 0


@pytest.mark.parametrize("radius, count", [(3, 2), (5, 3), (2, 3)])
def test_segments_meet_every_pair(radius, count):
    rng = np.random.default_rng(1)
    for _ in range(2000):
        mask = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(((mask >> low) & ((1 << width) - 1)).bit_count() <= r for low, width, r in segments(radius, count))


@pytest.mark.parametrize("heavy", [64, 8, 2])
def test_links_are_all_pairs(spark, heavy):
    """Random fingerprints, families around some, and many that share 32 or 48 bits, against brute force."""
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    fps += [f ^ sum(1 << int(b) for b in rng.integers(0, 63, int(rng.integers(0, 4)))) for f in fps[:60] for _ in range(4)]
    fps += [(fps[0] >> 32 << 32) ^ int(x) for x in rng.integers(0, 1 << 32, 400)] + [(fps[1] >> 16 << 16) ^ int(x) for x in rng.integers(0, 1 << 16, 400)]
    fps = np.array(sorted(set(fps)), np.int64)
    want = {(int(a), int(b)) for i, a in enumerate(fps) for b in fps[i + 1 :][np.bitwise_count((fps[i + 1 :] ^ a).view(np.uint64)) <= 3]}
    got = near_links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 3, heavy).collect()
    assert len(want) > 500 and {tuple(r) for r in got} == want


def test_a_crowded_bucket_takes_rows_in_proportion(spark):
    """All fingerprints share a segment; what is indexed for each stays the same when they are four times as many."""
    rng, each = np.random.default_rng(5), []
    for n in (5_000, 20_000):
        fps = spark.createDataFrame([(int(x),) for x in np.unique(rng.integers(0, 1 << 32, n))], "fp long")
        own = _halves(fps.selectExpr("fp", "0L AS path", "fp AS rest"), 64, 3, False)
        assert own.select("path").distinct().count() == fps.count() + 1  # the shared segment, and each its own
        deep = _halves(_halves(own, 32, 3, True), 16, 3, True)
        each.append(deep.count() / n)
        assert near_links(fps).filter("bit_count(a ^ b) > 3").count() == 0
    assert abs(each[1] / each[0] - 1) < 0.02


def _groups(sets, similarity=0.8):
    """The least id that links of similar sets reach, for each id."""
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and label[a] != label[b] and (not (sets[a] | sets[b]) or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def test_near_duplicates(odd, empty, plain_rows):
    gone = {r["doc_id"]: r["keep_id"] for r in near_duplicates(odd).collect()}
    assert gone[7] == -5 and gone[100] == -5 and gone[101] == -5 and gone[103] == -5  # copies but for case and spaces
    assert gone == {a: b for a, b in _groups({r[0]: set(shingle_hashes(r[1], 5).tolist()) for r in plain_rows if r[0] is not None}).items() if a != b}
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len([r for r in plain_rows if r[0] not in gone])
    assert drop_near_duplicates(empty).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (1, "another text of this id that is not like it"), (2, long), (3, long + " more"), (3, long + " more"), (4, "alone " * 9)]
    gone = {r["doc_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert gone in ({2, 3}, {3})  # 1 speaks by one of its texts


def test_suffix_array():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.integers(1, 1 + int(rng.integers(1, 5)), int(rng.integers(0, 40)))
        sa = suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        if len(s) > 3:
            c = prefix_classes(s, sa, 3)
            assert all((c[i] == c[j]) == (s[i : i + 3].tolist() == s[j : j + 3].tolist()) for i in range(len(s) - 3) for j in range(len(s) - 3))


@settings(max_examples=50, deadline=None)
@given(st.text("abc", max_size=60), st.text("abc", min_size=12, max_size=20), st.text("abc", max_size=60))
def test_equal_windows_have_equal_anchors(left, mid, right):
    def of(text):
        out = {}
        for h, a, z in zip(*anchors(text.encode(), 10, 4)):
            for p in range(a, z + 1):
                assert text[p : p + 10] not in out or out[text[p : p + 10]] == h
                out[text[p : p + 10]] = h
        assert len(text) < 10 or set(out) == {text[i : i + 10] for i in range(len(text) - 9)}
        return out

    x, y = of(left + mid), of(mid + right)
    assert all(x[w] == y[w] for w in x.keys() & y.keys())


def test_window_classes():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 3, 4000).astype(np.uint8)
    for length in (8, 11, 16, 50):
        where = np.sort(rng.choice(len(data) - length, 1500, replace=False))
        strings = [data[i : i + length].tobytes() for i in where]
        got = window_classes(data, where, length)
        assert len(set(zip(strings, got.tolist()))) == len(set(strings)) == len(set(got.tolist()))
        text = data.astype(np.int64) + 1
        by_cover = prefix_classes(text, suffix_array(text), length)[where]
        assert len(set(zip(by_cover.tolist(), got.tolist()))) == len(set(strings))


def test_anchors_of_pieces_are_those_of_the_whole(monkeypatch):
    import quarry.llm.substring_dedup as m

    data = np.random.default_rng(8).integers(97, 101, 3000).astype(np.uint8).tobytes()
    at = lambda: {(int(i), int(x)) for x, a, z in zip(*anchors(data, 50, 26)) for i in range(a, z + 1)}
    whole = at()
    monkeypatch.setattr(m, "_PIECE", 257)
    assert at() == whole and len(whole) == 3000 - 49


@pytest.mark.parametrize("hot", [20_000, 1, 3])
def test_substrings(odd, empty, plain_rows, hot):
    length = 12
    first = {}
    for d, t, *_ in plain_rows:
        d = float("inf") if d is None else d
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    want = Counter()
    for d, t, *_ in plain_rows:
        b = (t or "").encode()
        gone = [any(first[b[s : s + length]] < (float("inf") if d is None else d) for s in range(max(0, i - length + 1), min(i, len(b) - length) + 1)) for i in range(len(b))]
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        want[(d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)] += 1
    got = remove_repeats(odd, length, 5, hot)
    assert Counter((*r[:5], bytes(r[5])) for r in got.collect()) == want
    assert remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_substrings_leave_one_table(odd, tmp_path, monkeypatch, hot):
    """Whatever the turns and the texts answered at once, results agree, and only the ranges that the result reads stay on disk."""
    import quarry.llm.substring_dedup as m

    want = Counter((*r[:5], bytes(r[5])) for r in remove_repeats(odd, 12, 5, hot).collect())
    monkeypatch.setattr(m, "_TOGETHER", 100)
    for turns in (1, 3):
        monkeypatch.setattr("quarry.llm.common.shared_dir", lambda _, turns=turns: f"file://{tmp_path}/{turns}")
        got = remove_repeats(odd, 12, 5, hot, task_contexts=50, turns=turns)
        assert Counter((*r[:5], bytes(r[5])) for r in got.collect()) == want
        assert [p.name for p in (tmp_path / str(turns)).glob("*/*")] == ["ranges"]


def test_parts_of_a_batch(monkeypatch):
    import quarry.llm.substring_dedup as m

    monkeypatch.setattr(m, "_TOGETHER", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(range(7)), pa.array(["ab", "cd", "", None, "12345678", "x", "yyy"])], ["d", "row", "text"])
    assert [p.column(0).to_pylist() for p in m._parts([batch, batch.slice(0, 0)])] == [[0, 1, 2, 3], [4], [5, 6]]


@pytest.mark.parametrize("how", [{}, {"crowd": 2, "patience": 0}, {"crowd": 3, "patience": 2}])
def test_near_duplicates_finds_every_pair(spark, how):
    """All links at or above the threshold, also in one large group and between documents that share a passage, against brute force."""
    rng, rows = np.random.default_rng(11), []
    passage = [f"p{i}" for i in range(60)]
    for g in range(30):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 900, 200)]
        for _ in range(60 if g == 0 else 4):
            w = list(base)
            for i in rng.choice(200, int(rng.integers(1, 4)), replace=False):
                w[i] = f"x{int(rng.integers(0, 10**9))}"
            rows.append(" ".join(w))
    for g in range(60):
        own = [f"q{g}w{i}" for i in range(int(rng.choice([0, 3, 5, 40, 200])))]
        rows.append(" ".join([*own, *passage]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert sum(0.8 <= like(a, b) < 0.85 for a in sets for b in sets if a < b) >= 20
    gone = {r["doc_id"]: r["keep_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert gone == {a: b for a, b in _groups(sets).items() if a != b}


def test_texts_of_few_ids_only_are_shuffled(spark, monkeypatch):
    import quarry.llm.near_dups as m

    texts = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "c long, text string")
    ids = spark.createDataFrame([(3, 1), (7, 2)], "c long, lo long")
    for few, kind in ((2, "LeftSemi"), (1, "")):
        monkeypatch.setattr(m, "_FEW", few)
        got = m._texts_of(texts, ids, ids)
        assert sorted(map(tuple, got.select("c", "text", "lo").collect())) == [(3, "t3", 1), (7, "t7", 2)]
        assert ("LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()) == bool(kind)
