"""Mixing, token files, the language model and the pipeline."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm.entropy_mix import entropy_mix, take_mix, water_fill
from quarry.llm.gru import Gru, document_scores
from quarry.llm.recurrent_lm import score_documents, tokens_of
from quarry.llm.token_codes import Encoder, all_tokens, default_vocabulary, read_documents, read_segments, to_levels, token, token_at, write_tokens


def test_water_fill():
    assert water_fill([10, 10, 10], (3, 1, 2), 1.5, 2.0) == pytest.approx([20.0, 25 / 3, 50 / 3])
    assert water_fill([], (1,), 1.5, 2.0) == [] and water_fill([0, 4], (3, 1), 1.5, 2.0) == [0.0, 6.0]


def test_mix(odd, empty, plain_rows):
    got = entropy_mix(odd, block_rows=8).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in plain_rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, want, size in zip(names, water_fill(sizes, (3, 1, 2), 1.5, 2.0), sizes):
        assert {r["source_size"] for r in by[s]} == {size} and by[s][0]["target"] == pytest.approx(want)
        assert abs(sum(r["taken"] for r in by[s]) - want) <= max(130, 0.02 * want) or s == "src9"
        assert sum(r["rate"] * r["size"] for r in by[s]) == pytest.approx(want, rel=1e-6, abs=1e-3)
    assert sorted(map(str, got)) == sorted(map(str, entropy_mix(odd, block_rows=8).collect()))
    taken = take_mix(odd.filter("doc_id <> 108"), block_rows=8)
    assert taken.columns == odd.columns
    assert entropy_mix(empty).count() == 0 and take_mix(empty).count() == 0


SAMPLES = ["", "a", " a", "a ", "a  b", "a\n b", "a \n b  \n\nc\t d 's it's 're", "x <|endoftext|> y", "a \x1c b ​ c ² ½ Ⅷ a_b", "   ", "a \u0085b 12 345abc !?? ...\r\n q", "a\0b c\0 \0d  e", "x 　y 字 😀."]


def test_mix_against_a_plain_solution(spark):
    """Rates by bisection of each source's sum, and whole copies next to them, for a hot source, ties, repeated rows and one very long text."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), f"s{int(s)}") for i, (n, s) in enumerate(zip(rng.integers(1, 400, 900), np.minimum(rng.integers(0, 9, 900), 3)))]
    rows += [(5000 + i, "w " * 50, "s1") for i in range(40)] + [(7, "tie " * 9, "s2")] * 5 + [(9000, "w " * 60_000, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = entropy_mix(docs).toPandas()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in sorted({r[2] for r in rows})}
    want = dict(zip(sizes, _targets(list(sizes.values()))))
    for s, mine in got.groupby("source"):
        n, mean = mine["size"].to_numpy(float), mine["size"].sum() / len(mine)
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (n * np.minimum(2, np.exp(np.minimum(mid * n / mean, 700)))).sum() < want[s] else (low, mid)
        full = want[s] >= 2 * sizes[s] * (1 - 1e-9)
        assert np.allclose(mine["rate"], 2.0 if full else np.minimum(2, np.exp(np.minimum(low * n / mean, 700))), rtol=1e-5)
        assert math.isclose(mine["target"].iloc[0], want[s], rel_tol=1e-9) and (mine["source_size"] == sizes[s]).all()
        assert ((mine["copies"] >= np.floor(mine["rate"])) & (mine["copies"] <= np.ceil(mine["rate"]))).all()
        assert abs(mine["taken"].sum() - want[s]) <= 60_000 * (s == "s0") + 0.01 * want[s]
    assert Counter(map(tuple, entropy_mix(docs.repartition(2)).collect())) == Counter(map(tuple, entropy_mix(docs).collect()))


def _targets(sizes):
    """Shares by weight 3, 1, 2, again and again; what is above twice a size goes to the others."""
    weights, full = [(3, 1, 2)[i % 3] for i in range(len(sizes))], set()
    while True:
        left = 1.5 * sum(sizes) - sum(2 * sizes[i] for i in full)
        total = sum(w for i, w in enumerate(weights) if i not in full)
        part = [2 * n if i in full else left * weights[i] / total for i, n in enumerate(sizes)]
        more = {i for i, n in enumerate(sizes) if i not in full and part[i] > 2 * n}
        if not more:
            return part
        full |= max([{i} for i in more], key=lambda x: part[min(x)] / sizes[min(x)])


def test_repeated_and_null_ids_lose_no_copies(spark):
    rows = [(None, f"a text of {i % 3} words", "s", i) for i in range(300)] + [(1, "the same id", "s", i) for i in range(50)] + [(2, "b " * i, "t", i) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copies long")
    want = Counter()
    for r in entropy_mix(docs).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got = Counter()
    for r in take_mix(docs).collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
    assert got == want and take_mix(docs).columns == docs.columns


def test_encoder_equals_the_library():
    enc = Encoder(default_vocabulary(), remember=8)
    for s in SAMPLES * 2:
        assert np.frombuffer(enc.encode(s), enc.kind).tolist() == enc.library.encode(s, add_special_tokens=False).ids


def test_encoder_on_characters_of_all_kinds():
    rng = np.random.default_rng(2)
    kinds = [range(0, 128), range(0, 256), range(32, 1000), [*range(0x2000, 0x2070), 97, 32, 49], [*range(0x1F600, 0x1F610), 32, 0x3000, 0x661, 97]]
    enc = Encoder(default_vocabulary(), remember=50)
    for kind in kinds:
        for _ in range(60):
            text = "".join(chr(int(c)) for c in rng.choice(list(kind), 40))
            assert np.frombuffer(enc.encode(text), enc.kind).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_codes_give_every_token():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 3000)
    chunks, more, ranks = to_levels(ids)
    assert len(chunks) == 3 and (all_tokens(chunks, more) == ids).all()
    assert [token_at(chunks, more, ranks, i) for i in range(3000)] == ids.tolist()


def test_token_files(spark, odd, empty, plain_rows, tmp_path):
    write_tokens(odd, f"file://{tmp_path}/t", shard_docs=7, segment_tokens=50)
    library = Tokenizer.from_file(default_vocabulary())
    rows = sorted(plain_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {id(r): [*library.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    got = sorted(map(tuple, read_documents(spark, f"file://{tmp_path}/t").collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in rows]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((r[0], len(ids[id(r)]), crc(ids[id(r)])) for r in rows)
    parts = read_segments(spark, f"file://{tmp_path}/t").orderBy("shard", "seg").collect()
    assert sum(p["n_tokens"] for p in parts) == at and len(parts) > 5
    p = parts[-1]
    assert [token_at(p["chunks"], p["more"], p["ranks"], i) for i in range(p["n_tokens"])] == all_tokens(p["chunks"], p["more"]).tolist()
    for r in rows[:3] + rows[-3:]:
        if r[0] is not None and r[0] != 108:
            assert [token(spark, f"file://{tmp_path}/t", r[0], i) for i in {0, len(ids[id(r)]) // 2, len(ids[id(r)]) - 1}] == [ids[id(r)][i] for i in {0, len(ids[id(r)]) // 2, len(ids[id(r)]) - 1}]
    with pytest.raises(IndexError):
        token(spark, f"file://{tmp_path}/t", 3, 10**6)
    write_tokens(empty, f"file://{tmp_path}/e")
    assert read_documents(spark, f"file://{tmp_path}/e").count() == 0


def _loss(g, x, s, c, w, h):
    table, total = g.table(), 0.0
    for t in range(len(x)):
        h = g.step(table[x[t]], np.where(s[t][:, None], 0, h))
        total -= g.log_probs(h, c[t], w[t]).sum()
    return total / x.size


def test_gradients_and_windows():
    g, r = Gru(9, [0, 2, 5], 3, hidden=4), np.random.default_rng(0)
    g.p = {k: v.astype(float) * 3 for k, v in g.p.items()}
    pick = lambda c: np.where(c == 0, r.integers(0, 2, c.shape), np.where(c == 1, r.integers(2, 5, c.shape), -1))
    x, s, c, h = r.integers(0, 9, (5, 3)), r.random((5, 3)) < 0.3, r.integers(0, 5, (5, 3)), r.standard_normal((3, 4))
    w = pick(c)
    grads, _ = g.gradients(x, s, c, w, h)
    for name, p in g.p.items():
        i = tuple(r.integers(0, n) for n in p.shape)
        old, e = p[i], 1e-5
        p[i] = old + e
        up = _loss(g, x, s, c, w, h)
        p[i] = old - e
        down = _loss(g, x, s, c, w, h)
        p[i] = old
        assert abs((up - down) / (2 * e) - grads[name][i]) < 1e-6
    docs = []
    for n in (7, 1, 130, 64, 65, 3):
        c = r.integers(0, 5, n)
        docs.append((r.integers(0, 9, n), c, pick(c)))
    for got, (x, c, w) in zip(document_scores(g, docs, 2, window=16, lanes=4), docs):
        h, want, last = np.zeros((1, 4)), 0.0, 2
        for t in range(len(x)):
            h = g.step(g.table()[[last]], h)
            want += g.log_probs(h, c[t : t + 1], w[t : t + 1])[0]
            last = x[t]
        assert abs(got - want) < 1e-6


def test_scores(odd, empty, plain_rows):
    got = score_documents(odd, frequent=40, classes=4, block_tokens=500).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t, *_ in plain_rows if not held(d) for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for d, t, *_ in plain_rows:
        w = tokens_of(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        want[(d, held(d), len(w), sum(count[x] > 0 for x in w), n, round(base, 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    long = [r for r in got if r["n_tokens"] > 100]
    assert sum(r["score"] for r in long) > sum(r["base_score"] for r in long)
    assert all(r["score"] < 0 for r in got)
    assert score_documents(empty).count() == 0


def test_held_out_texts_teach_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 40, 30))) for i in range(40)]
    out = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    assert out
    other = [(i, " ".join(["w1 other"] * 15) if i == out[0] else t) for i, t in rows]
    a, b = ({r["doc_id"]: (r["score"], r["base_score"], r["train_tokens"]) for r in score_documents(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).collect()} for x in (rows, other))
    assert {k: v for k, v in a.items() if k != out[0]} == {k: v for k, v in b.items() if k != out[0]} and a[out[0]] != b[out[0]]


def test_continuations_sum_to_one(odd):
    """Over all words that training saw and one unseen word in each rare class."""
    from quarry.llm.recurrent_lm import Lexicon, rare_class

    words = [("", 9), *[(f"w{i}", 5) for i in range(12)]]
    rest = [(f"rare{i}", 2) for i in range(30)]
    lex = Lexicon(words, 4, 3)
    lex.mass = np.ones(4)
    for w, c in rest:
        lex.mass[rare_class(w, 4)] += c + 1
    g = Gru(len(words) + 4, lex.bounds, 4, hidden=5)
    h = np.random.default_rng(2).standard_normal((1, 5)).astype(np.float32)
    _, k, w = lex.entries([x for x, _ in words])
    total = np.exp(g.log_probs(np.repeat(h, len(k), 0), k, w)).sum()
    _, k, w = lex.entries([x for x, _ in rest])
    inner = [(c + 1) / lex.mass[x - lex.frequent_classes] for (_, c), x in zip(rest, k)]
    total += (np.exp(g.log_probs(np.repeat(h, len(k), 0), k, w)) * inner).sum()
    rare = lex.frequent_classes + np.arange(4)
    total += (np.exp(g.log_probs(np.repeat(h, 4, 0), rare, np.full(4, -1))) / lex.mass).sum()
    assert total == pytest.approx(1, abs=1e-5)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, sizes = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] >= 0.95 * 200 and sizes[0] > sizes[1] >= sizes[2] > 0
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r["doc_id"] for r in docs.select("doc_id").collect()}


@pytest.mark.parametrize("body", ["short", "a long text of many words " * 4000])
def test_stages_bound_what_python_holds_at_once(spark, sf, body):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = 3000 if body == "short" else 300
    docs = spark.range(0, rows, 1, 1).selectExpr("id AS doc_id", f"concat('{body}', id) AS text", "'en' AS lang", "'a' AS source")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
            spark.conf.unset(key)
        stage(spark, docs.limit(0), sf)
        got = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
        assert sum(r["n"] for r in got) == rows, name
        assert max(r["n"] for r in got) <= 512 and max(r["size"] for r in got) < 6 << 20, name


def test_every_training_token_reaches_a_gradient(spark):
    """More documents than any sample of 600; few tokens are read in each of four rounds, more once."""
    from quarry.llm.recurrent_lm import Lexicon, blocks_of, held_out, train

    docs = spark.createDataFrame([(i, f"common w{i % 7} {'more ' * (i % 3)}") for i in range(1500)], "doc_id long, text string").repartition(3)
    blocks = blocks_of(docs.withColumn("held", held_out()), 500)
    tokens = sum(len(tokens_of(r["text"])) for r in docs.filter(~held_out()).collect())
    lexicon = Lexicon([("common", 9), ("", 9), ("more", 5), ("w1", 1)], 4, 3)
    assert train(blocks, lexicon, tokens)[1] == 4 * tokens
    model, seen = train(blocks, lexicon, tokens, few=100, tasks=2)
    assert seen == tokens
    assert (model.p["Ww"] != Gru(len(lexicon.words) + 4, lexicon.bounds, 4).p["Ww"]).any()


def test_tokens_of_slices():
    """All texts at once give the tokens of each, from the middle of a batch too."""
    from quarry.llm.recurrent_lm import _tokenised

    texts = ["Ünder é", None, "", " \x0b\x0cA\x1cB\x85c d\r\n", "à b à", "zz É", "\t", "end"]
    for lo, hi in ((0, 8), (1, 7), (4, 6), (3, 3)):
        words, sizes = _tokenised(pa.array(texts).slice(lo, hi - lo))
        assert words.to_pylist() == [w.decode() for t in texts[lo:hi] for w in tokens_of(t)]
        assert sizes.tolist() == [len(tokens_of(t)) for t in texts[lo:hi]]


def test_large_weights_are_shifted():
    g, r = Gru(9, [0, 2, 5], 3, hidden=4), np.random.default_rng(0)
    g.p = {k: v * 4000 for k, v in g.p.items()}
    c = np.array([0, 1, 4, 1])
    got = g.log_probs(np.tanh(r.standard_normal((4, 4))).astype(np.float32), c, np.array([1, 3, -1, 2]))
    assert np.isfinite(got).all() and (got <= 0).all()


def test_no_size_changes_the_training(spark, monkeypatch):
    """However few, all training tokens are followed once."""
    from quarry.llm import recurrent_lm

    seen, train = [], recurrent_lm.train
    monkeypatch.setattr(recurrent_lm, "train", lambda *a, **k: seen.append(train(*a, **k)) or seen[-1])
    for n in (3, 300):
        docs = spark.createDataFrame([(i, f"some words of {i % 9}") for i in range(n)], "doc_id long, text string")
        total = {r["train_tokens"] for r in score_documents(docs, block_tokens=200).collect()}
        assert {seen[-1][1]} == total
