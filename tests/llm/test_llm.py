"""Operators for training text against brute force, on small tables with hard rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from newsloom.llm import bytewords as bw  # noqa: E402
from newsloom.llm import chat, decontaminate, importance, langid, licenses, lm, ngramjoin, packing, tokenfile, tokens, winnow  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["", " ", None, "é", "İstanbul ΣΑΣ's don'T 12.5%", "a\x01b\n\n  c　d \n e", "x" * 300_000, "<|endoftext|> [INST] </s>", "word " * 3000, "日本語のテキスト。", "tab\tsep\r\nline!!! ... don't 'tis"]


def rnd_words(seed, n, v=60):
    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(v)}" for _ in range(n)]


def docs_of(spark, texts, start=0, **more):
    rows = [(i + start, t, *(m[i] for m in more.values())) for i, t in enumerate(texts)]
    kinds = "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, f"doc_id long, text string{kinds}")


def test_words_and_hashes():
    texts = ["Ab cd", "", "  x ", None, "é\x0bAB", "q" * 400_000 + " ab"]
    buf, offs = bw.flat(pa.array(texts, pa.string()))
    t = bw.words(buf, offs, bw.SPACED)
    want = [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    got = [[t.raw(i).decode() for i in range(t.first[k], t.first[k + 1])] for k in range(len(texts))]
    assert got == want
    h = bw.hashes(t.buf, t.starts, t.ends, True)
    same = collections.defaultdict(set)
    for x, y in zip([w.translate(LOW) for ws in want for w in ws], h.tolist()):
        same[x].add(y)
    assert all(len(v) == 1 for v in same.values()) and len({*h.tolist()}) == len(same)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_token_ids_are_the_librarys(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    r = random.Random(1)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "a", "b ", "\n", "!!", "<|", "endoftext", "|>", "é", "  ", "日本", "'s", "　", "12"]
    texts = ["".join(r.choices(parts, k=r.randrange(9))) for _ in range(500)] + ["<|endoftext", "|>"]
    texts += [x or "" for x in HARD if x is None or len(x) < 50_000] + [" ".join(rnd_words(i, 50)) + random.Random(i).choice("!?… \x85") for i in range(50)]
    own = tokens.Tokens(path)
    ids, at = own.encode(*bw.flat(pa.array(texts, pa.string())))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def brute_hits(text, items, window=10):
    find = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    w, hit, ids = find(text), set(), set()
    for k, x in items:
        v = find(x)
        m = min(window, len(v))
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                ids.add(k)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontaminate(spark, limit):
    items = [(1, " ".join(rnd_words(1, 30))), (2, "Short one"), (3, "ONE"), (4, None), (5, "..."), (6, " ".join(rnd_words(1, 30))), (7, "a b a b a b a b a b a b")]
    texts = [" ".join(rnd_words(i, 40) + rnd_words(1, 30)[5:20] + ["short-ONE!", "x"]) for i in range(20)] + ["a b " * 30, "one", "shortone"] + HARD
    d = docs_of(spark, texts, hits=["kept"] * len(texts), other=["o"] * len(texts))
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.find(d, b, block_bytes=limit).collect():
        n, h, ids = brute_hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, h, ids), texts[r.doc_id][:50]
        assert sum(x.length for x in r.hits) == h and r.other == "o"
    assert decontaminate.find(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find(d.limit(0), b).count() == 0


@pytest.mark.parametrize("kind", ["short", "int", "decimal(9,1)", "double", "date", "string"])
def test_item_ids_of_any_type(spark, kind):
    rows = "(DATE'2024-01-01'), (DATE'2024-01-02')" if kind == "date" else "(1), (2)"
    one, two = spark.sql(f"SELECT CAST(x AS {kind}) FROM VALUES {rows} AS t(x)").collect()
    items = spark.createDataFrame([(one[0], "a b c"), (two[0], "c d e")], f"item_id {kind}, text string")
    got = {r.doc_id: sorted(r["items"]) for r in decontaminate.find(docs_of(spark, ["x a b c d e", "z", "a b c"]), items).collect()}
    assert got == {0: [one[0], two[0]], 1: [], 2: [one[0]]}


def test_winnow_positions_and_guarantee():
    r = random.Random(3)
    text = "".join(r.choice("abcdé ") for _ in range(900))
    h, at = winnow.winnow(text, 5, 8)
    grams = winnow.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), 5) >> np.uint64(32)
    want = set()
    for i in range(len(grams) - 7):
        part = grams[i : i + 8]
        want.add(i + max(k for k in range(8) if part[k] == part.min()))
    assert set(at.tolist()) == want
    assert len(set(grams.tolist())) == len({text[i : i + 5] for i in range(len(grams))})
    assert winnow.parsed(winnow.written(h, at))[1].tolist() == at.tolist()


def test_fingerprints_of_neighbours(spark):
    texts = [" ".join(rnd_words(i // 2, 120)) for i in range(40)] + HARD
    d = docs_of(spark, texts)
    got = {r.doc_id: r for r in winnow.compare_with_edits(d).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t = t or ""
        nxt = texts[i - 1 if i else len(texts) - 1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.fingerprint == winnow.written(*winnow.winnow(t)) and r.edited_fingerprint == winnow.written(*winnow.winnow(e))
        assert 0 <= r.near_edited <= 1 and r.near_next == pytest.approx(winnow.likeness(np.unique(winnow.winnow(t)[0]), np.unique(winnow.winnow(nxt)[0])))
    assert got[1].near_next == 1.0 and got[5].fingerprint == got[4].fingerprint
    assert winnow.compare_with_edits(d.limit(0)).count() == 0
    assert winnow.compare_with_edits(d.where("doc_id = 3")).first().near_next == 1.0


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", r"<\/s> [\\INST]", "[/INST] ", " ", "", "<s", "[INST", "\\", "<s>[INST] user [/INST] x </s>"])
def test_chat_round_trip(spark, text):
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, None, text, "y"), (1, 1, "assistant", text), (None, 0, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat(d).withColumn("back", chat.recovered(chat.parse(F.col("formatted")))).collect()}
    want = sorted([(t if t is not None else -1, r, x) for c, t, r, x in rows if c == 1])
    assert [(t.role, t.text) for t in got[1].back] == [(r, x) for _, r, x in want]
    assert "".join(p.content for p in got[1].pieces) == got[1].formatted
    assert [(t.role, t.text) for t in got[None].back] == [("", "")]
    trained = sum(r == "assistant" for _, r, _ in want)
    digest = {r.conv_id: r for r in chat.digest(chat.chat(d)).collect()}[1]
    loss = "".join(x for _, r, x in want if r == "assistant")
    assert trained and digest.loss_chars == len(loss) and digest.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].formatted.count("</s>") == 4 and chat.chat(d.limit(0)).count() == 0


def brute_lm(texts, train):
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\0end"] for i, t in texts.items()}
    c = collections.Counter(w for i in train for w in tok[i])
    n, v = sum(c.values()), len(c)
    bi = collections.Counter((a, b) for i in train for a, b in zip(["\0b", *tok[i]], tok[i]))

    def disc(counts):
        a = [collections.Counter(counts)[k] for k in (1, 2, 3, 4)]
        y = a[0] / (a[0] + 2 * a[1]) if a[0] else 0
        return [min(max(k - (k + 1) * y * a[k] / a[k - 1] if a[k - 1] else 0.0, 0), k) for k in (1, 2, 3)]

    of = lambda k, d: 0 if k == 0 else d[min(k, 3) - 1]
    high, cont = disc(bi.values()), collections.Counter(b for _, b in bi)
    low, m = disc(cont.values()), sum(cont.values())
    rest = sum(of(k, low) for k in cont.values()) / m
    p1 = lambda w: max(0, cont[w] - of(cont[w], low)) / m + rest / (v + 1)
    ctx, g = collections.Counter(), collections.Counter()
    for (a, _), k in bi.items():
        ctx[a] += k
        g[a] += of(k, high)
    out = {}
    for i, t in tok.items():
        s = sum(math.log10((max(0, bi[a, b] - of(bi[a, b], high)) + g[a] * p1(b)) / ctx[a]) if ctx[a] else math.log10(p1(b)) for a, b in zip(["\0b", *t], t))
        out[i] = (len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), s)
    return out


def test_language_model(spark):
    texts = dict(enumerate([" ".join(rnd_words(i, 80, 12)) for i in range(60)] + [h for h in HARD if h is None or len(h) < 20_000]))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    want = brute_lm(texts, train)
    rows = lm.digest(lm.score_held_out(d.withColumn("score", F.lit("old")))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.held_out == (r.doc_id not in train)
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)
    none = lm.score(d, lm.train(d.limit(0))).collect()
    assert all(r.score == 0 and r.n_known == 0 for r in none)


def test_counts_of_pairs_have_no_cap(tmp_path):
    h, folder = np.arange(3, dtype=np.uint64), f"file://{tmp_path}"
    for kind, n in (("<u4", [1, 2, 2**32 - 1]), ("<u8", [1, 2, 2**32 + 5])):
        path = lm._save(folder, "pairs", h, np.array(n, kind))
        opened = lm.Opened(lm.Model([(path, 3)], [], h[:0], 0, 0, (0, 0, 0), 0.0, "m"))
        assert opened._look([(path, 3)], lm._PAIR, np.zeros(3, np.int64), h)[0].tolist() == n


def brute_importance(texts, target):
    """Log weights by plain loops over features."""
    f = {}
    for i, t in texts.items():
        f[i] = importance.features(*bw.flat(pa.array([t], pa.string())))[0].tolist()
    raw, tar = collections.Counter(x for v in f.values() for x in v), collections.Counter(x for i in target for x in f[i])
    n, m = sum(raw.values()), sum(tar.values())
    return {i: sum(math.log((tar[x] + importance.PSEUDO) / (raw[x] * m / n + importance.PSEUDO)) for x in v) for i, v in f.items()}


def test_importance(spark):
    r = random.Random(1)
    texts, labels = {}, []
    for i in range(400):
        w = rnd_words(i, 60)
        kind = r.random()
        if kind < 0.2:
            w = [x + "%%%" for x in w]
        elif kind < 0.35:
            w[5] = w[30] = "idiot"
        texts[i] = " ".join(w)
        labels.append((i, int(kind >= 0.2), int(0.2 <= kind < 0.35)))
    texts |= dict(enumerate(HARD, 400))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    taught = labels[:200]
    lab = spark.createDataFrame([*taught, (1, None, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    want = brute_importance(texts, [i for i, q, t in taught if q and not t and i != 3])
    model = importance.fit(d, lab)
    keys = {x.doc_id: x for x in importance.weigh(d, model).collect()}
    assert {i: x.log_weight for i, x in keys.items()} == pytest.approx(want, abs=1e-6)
    assert model["share"] == sum(q and i != 3 for i, q, _ in taught) / 200
    kept = {x.doc_id for x in importance.resample(d, lab).collect()}
    best = sorted(texts, key=lambda i: -keys[i].gumbel_key)
    assert kept == set(best[: round(model["share"] * len(texts))])
    held = labels[200:]
    assert sum(i in kept for i, q, _ in held if q) > 0.95 * sum(q for _, q, _ in held) and sum(i in kept for i, q, _ in held if not q) <= 0.1 * sum(not q for _, q, _ in held)
    assert {x.doc_id for x in importance.resample(d, lab, share=0.1).collect()} == set(best[: round(0.1 * len(texts))])
    clash = d.withColumns({"log_weight": F.lit("x"), "gumbel_key": F.lit(1), "_key": F.lit("k"), "_id": F.lit(2), "target": F.lit("t")})
    rows = importance.select(clash.unionByName(clash.where("doc_id < 5")), lab)
    assert rows.columns == clash.columns and {(x.log_weight, x.gumbel_key, x._key) for x in rows.collect()} == {("x", 1, "k")}
    assert importance.resample(d, lab.limit(0)).count() == len(texts) == importance.select(d, lab.where("quality = 0")).count()
    assert importance.resample(d.limit(0), lab).count() == 0 == importance.select(clash.limit(0), lab).count()
    nulls = spark.createDataFrame([(None, "a"), (None, None), (7, "a")], "doc_id long, text string")
    assert importance.resample(nulls, lab, share=1.0).count() == 3


def test_importance_weak_signs(spark):
    """Low-quality texts hold all words, half of them three times as often: no single word tells."""
    r = random.Random(4)
    good, weak = [f"{x}q" for x in "abcdefghijklmnopqrst"], [f"{x}z" for x in "abcdefghijklmnopqrst"]
    texts = [" ".join(r.choice(weak if r.random() < (0.6 if i % 4 == 0 else 0.2) else good) for _ in range(30)) for i in range(1200)]
    lab = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(800)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in importance.resample(docs_of(spark, texts), lab).collect()}
    assert sum(i in kept for i in range(800, 1200) if i % 4) > 0.9 * 300 and sum(i in kept for i in range(800, 1200, 4)) < 0.3 * 100


def test_kth_largest(spark):
    v = [random.Random(2).choice([1.5, 2.5, -3e9, random.Random(i).random()]) for i in range(500)]
    d = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 7, 250, 500):
        assert importance.kth_largest(d, "x", k, bins=8) == sorted(v, reverse=True)[k - 1]


def test_packing(spark):
    texts = [" ".join(rnd_words(i, 5 * i)) for i in range(120)] + HARD
    d = docs_of(spark, texts, sequence_id=["z"] * len(texts)).repartition(3)
    rows = packing.pack(d, BYTE).collect()
    own = tokens.Tokens(BYTE)
    by, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(by) == set(range(len(texts)))
    for i, rs in by.items():
        ids = np.append(own.encode(*bw.flat(pa.array([texts[i]], pa.string())))[0], 0).astype("<u4")
        rs.sort(key=lambda r: r.start)
        assert b"".join(r["ids"] for r in rs) == ids.tobytes() and all(r.doc_tokens == len(ids) for r in rs)
        assert all(r.start == sum(x.length for x in rs[:k]) for k, r in enumerate(rs))
    padded = total = 0
    for rs in seqs.values():
        rs.sort(key=lambda r: r.offset)
        n = sum(r.length for r in rs)
        assert n <= 1024 and all(r.offset == sum(x.length for x in rs[:k]) for k, r in enumerate(rs))
        total += n
        padded += 0 if n & (n - 1) == 0 else 1024 - n
    assert padded < 0.02 * total
    assert packing.pack(d.limit(0), BYTE).count() == 0


def brute_join(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i in keys:
        for j in keys:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in keys}


@pytest.mark.parametrize("small, cell, deal", [(64, 2_000_000, 100_000), (3, 400, 100_000), (64, 300, 100_000), (3, 4_000_000, 2)])
def test_jaccard_join(spark, monkeypatch, small, cell, deal):
    monkeypatch.setattr(ngramjoin, "SLICE", deal)
    monkeypatch.setattr(ngramjoin, "PAIRS", 50)
    monkeypatch.setattr(ngramjoin, "SMALL", small)
    monkeypatch.setattr(ngramjoin, "MANY", small)
    monkeypatch.setattr(ngramjoin, "CELL", cell)
    r = random.Random(5)
    texts = []
    for g in range(6):
        base = rnd_words(g, 90, 500)
        for _ in range(9):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w[: r.choice([90, 90, 85, 75])]))
    texts += [" ".join(rnd_words(100 + i, 40, 500) + rnd_words(7, 30, 500)) for i in range(12)] + HARD + ["A b c", "a B c", "a b c d", texts[3]]
    d = docs_of(spark, texts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.join(d).collect()}
    assert got == brute_join(list(enumerate(texts)))
    if deal != 2:
        return
    clash = d.unionByName(d.where("doc_id = 0")).withColumns({"class": F.lit(1), "_kept": F.lit("k"), "component_id": F.lit(2), "n": F.lit(3)})
    kept = ngramjoin.one_of_each(clash)
    assert kept.columns == clash.columns and {(x._kept, x.component_id) for x in kept.collect()} == {("k", 2)}
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in got.values()})
    twice = spark.createDataFrame([(1, "b b b", "x"), (1, "a a a", "z"), (1, "a a a", "y"), (None, "q", "w")], "doc_id long, text string, _kept string")
    assert sorted((x.text, x._kept) for x in ngramjoin.one_of_each(twice).collect()) == [("a a a", "y"), ("q", "w")]
    assert ngramjoin.one_of_each(clash.limit(0)).count() == 0
    assert ngramjoin.join(d.limit(0)).count() == 0
    null = spark.createDataFrame([(None, texts[0]), (5, texts[0]), (5, texts[0])], "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in ngramjoin.join(null).collect()) == [(-1, -1), (5, 5), (5, 5)]


def test_cells_come_back():
    rng = np.random.default_rng(3)
    for m in (1, 7, 5000):
        cells, n = np.sort(rng.choice(1 << 16, m, replace=False)), rng.integers(1, 1 << rng.integers(1, 32), m)
        got = ngramjoin.unpacked(ngramjoin.packed(cells, n), m)
        assert (got[0] == cells).all() and (got[1] == n).all()


@pytest.fixture
def few_at_once(spark, monkeypatch):
    """Documents are scanned two at a time, so none of their shingles is in three; returns the edges that make families."""
    met, real = [], ngramjoin.components

    def seen(edges, name="components"):
        met.extend([tuple(x) for x in edges.collect()] if name == "families" else [])
        return real(edges, name)

    monkeypatch.setattr(ngramjoin, "components", seen)
    monkeypatch.setattr(ngramjoin, "FLUSH", 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    yield met
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_common_line_ties_no_documents(spark, few_at_once):
    """A line that more than MANY documents have, two of each batch: no shingle of it may put them in one family."""
    line = " ".join(rnd_words(1, 20, 500))
    texts = [" ".join(rnd_words(10 + i, 60, 500)) + "\n" + line for i in range(ngramjoin.MANY + 100)]
    texts += [texts[0] + " end", texts[1]]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngramjoin.join(docs_of(spark, texts).coalesce(1)).collect()}
    assert got == brute_join(list(enumerate(texts)))
    assert len(few_at_once) == 1


def test_the_stage_ties_no_documents_by_a_common_line(spark, few_at_once):
    line = " ".join(rnd_words(1, 20, 500))
    texts = [" ".join(rnd_words(10 + i, 60, 500)) + "\n" + line for i in range(ngramjoin.MANY + 100)]
    kept = pytest.importorskip("corpus_pipeline").near_duplicates(spark, docs_of(spark, [*texts, texts[2], f"{texts[3]} end", None]).coalesce(1), "")
    assert {x.doc_id for x in kept.collect()} == {*range(len(texts)), len(texts) + 2}
    assert len(few_at_once) == 1


def some_sets(kind, m, rng, size=90):
    out, base = [], rng.integers(0, 1 << 60, size).astype(np.uint64)
    for i in range(m):
        if kind == "copies" or kind == "far":  # of one set, with few or many changes
            b, k = base.copy(), rng.integers(0, 6 if kind == "copies" else 14)
        elif kind == "families":  # that have half in common
            if i % 10 == 0:
                family = np.concatenate([base[: size // 2], rng.integers(0, 1 << 60, size - size // 2).astype(np.uint64)])
            b, k = family.copy(), rng.integers(0, 12)
        elif kind == "dense":
            b, k = rng.choice(100, size=rng.integers(80, 97), replace=False).astype(np.uint64), 0
        else:
            b, k = rng.integers(0, 1 << 60, size).astype(np.uint64), 0
        if k:
            b[rng.choice(size, k, replace=False)] = rng.integers(0, 1 << 60, k)
        out.append(np.unique(b))
    return out


def parts_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("kind", ["copies", "far", "families", "dense", "unrelated"])
@pytest.mark.parametrize("steps", [0, 3, 1000])
def test_forest(monkeypatch, kind, steps):
    monkeypatch.setattr(ngramjoin, "STEPS", steps)
    rng, m = np.random.default_rng(steps), 100
    sets = some_sets(kind, m, rng)
    plain = [set(x.tolist()) for x in sets]
    linked = [(i, j) for i in range(m) for j in range(i + 1, m) if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])]
    found = ngramjoin.forest(sets, np.full(m, 2), (80, 100))
    assert parts_of(m, found) == parts_of(m, linked) and {(min(x), max(x)) for x in found} <= set(linked)
    side = rng.integers(0, 2, m)
    found = ngramjoin.forest(sets, side, (80, 100))
    within = [(i, j) for i, j in linked if side[i] == side[j]]
    assert parts_of(m, within + found) == parts_of(m, linked) and {(min(x), max(x)) for x in found} <= set(linked)


@pytest.mark.parametrize("kind", ["copies", "unrelated"])
def test_forest_grows_in_proportion(monkeypatch, kind):
    """Comparisons, not seconds: sets that are compared or walked, for sixteen times the sets."""
    counted = []
    for m in (200, 3200):
        n = 0

        def intersect(*a, real=np.intersect1d, **k):
            nonlocal n
            n += 1
            return real(*a, **k)

        monkeypatch.setattr(np, "intersect1d", intersect)
        monkeypatch.setattr(ngramjoin.Trie, "overlaps", lambda *a: pytest.fail("nothing is left for the trie"))
        ngramjoin.forest(some_sets(kind, m, np.random.default_rng(1)), np.full(m, 2), (80, 100))
        counted.append(n)
        monkeypatch.undo()
    assert counted[1] <= 2 * 16 * max(counted[0], 1)


def test_language_id(spark):
    rows, r = [], random.Random(1)
    stems = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["sch", "und", "keit", "ü", "ich"], "fr": ["eau", "les", "é", "oi", "que"]}
    for i in range(240):
        name = r.choice([*stems])
        rows.append((i, " ".join("".join(r.choices(stems[name], k=3)) for _ in range(30)), name if i % 9 else None))
    rows += [(1000 + k, h, "en") for k, h in enumerate(HARD) if h is None or len(h) < 100]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.digest(langid.identify(d.withColumn("score", F.lit(9)), PIECES)).collect()}
    truth = {i: next((n for n in stems if any(t.startswith(s) for s in stems[n])), None) for i, t, _ in rows[:240]}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in held) and sum(got[i].lang_pred == truth[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= x.score <= 1 for x in got.values())
    for i, t, _ in rows[240:]:
        assert (got[i].lang_pred == "und") == (not t or not any(c.isalpha() for c in t)), t
    assert {x.lang_pred for x in langid.predict(d, [], np.zeros((0, 0)), PIECES).collect()} == {"und"}
    clash = d.withColumns({"_guess": F.lit("g"), "score": F.lit("s"), "lang_pred": F.lit("l"), "_s": F.lit("x")})
    rows = langid.certain(clash, PIECES, 0.5)
    assert rows.columns == clash.columns and {(x._guess, x.score, x.lang_pred, x._s) for x in rows.collect()} == {("g", "s", "l", "x")}
    assert langid.certain(clash.limit(0), PIECES, 0.5).count() == 0 == langid.identify(d.limit(0), PIECES).count()


def all_pieces():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    return {sp.id_to_piece(i).encode(): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}


def brute_forward(w, ids, byte, lp):
    f = [np.zeros(lp.shape[1])] + [np.full(lp.shape[1], -np.inf) for _ in w]
    for e in range(1, len(w) + 1):
        for a in range(e):
            if w[a:e] in ids:
                f[e] = np.logaddexp(f[e], f[a] + lp[ids[w[a:e]]])
        f[e] = np.logaddexp(f[e], f[e - 1] + lp[byte[w[e - 1]]])
    return f[-1]


def test_forward_sums_all_segmentations(monkeypatch):
    v, ids = langid.Vocabulary.of(PIECES), all_pieces()
    rng, r = np.random.default_rng(1), random.Random(2)
    p = rng.random((v.size, 2)) ** 8
    p /= p.sum(0)
    alphabets = ["etaoinshr", "администрцявкоый", "日本語のテキスト中文的", "▁ x\x01é"]
    words = ["", "the", "representation", "▁▁▁▁▁▁▁▁", "администрация", "который", "x" * 300]
    words += ["".join(r.choices(a, k=n)) for a in alphabets for n in (1, 2, 5, 13, 40, 100)]
    words += [k.decode() for k in sorted(ids, key=len)[-3:]]
    w = [langid.marked(x.encode()) for x in words]
    want = [brute_forward(x, ids, v.byte, np.log(p)) for x in w]
    got = langid.word_scores(v, p, w)
    assert np.allclose(got, want, rtol=1e-10) and max(len(x) for x in w) > 300
    monkeypatch.setattr(langid, "LONG", 3)
    assert np.allclose(langid.word_scores(v, p, w), want, rtol=1e-10)
    # expected counts: the derivative of the sum by each probability's logarithm, and all bytes of all words
    who, n, total = np.arange(len(w)) % 2, np.arange(1, len(w) + 1), np.zeros((v.size, 2))
    langid.expected(v, p, w, who, n, total)
    for piece in np.argsort(-total.sum(1))[:6]:
        q = p.copy()
        q[piece] *= 1 + 1e-6
        rise = (langid.word_scores(v, q, w) - got) / 1e-6
        for k in range(2):
            assert (rise[who == k, k] * n[who == k]).sum() == pytest.approx(total[piece, k], rel=1e-3, abs=1e-6)
    length = np.ones(v.size)
    length[list(ids.values())] = [len(x) for x in ids]
    assert np.allclose(length @ total, [sum(int(c) * len(x) for x, h, c in zip(w, who, n) if h == k) for k in range(2)])


def test_language_training_and_posteriors(spark):
    """One round of training and the posteriors against plain loops."""
    rows = [(i, " ".join(rnd_words(i, 6, 4)), "xy"[i % 2]) for i in range(12)] + [(20, None, "x"), (21, "y z", None), (None, "null id", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = langid.train(d, ~langid.held_out(), PIECES, rounds=1)
    v, ids = langid.Vocabulary.of(PIECES), all_pieces()
    total = np.zeros((v.size, 2))
    for i, t, name in rows:
        if t and name and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2):
            for word in t.split():
                w, k = langid.marked(word.encode()), "xy".index(name)
                paths = [(0, ())]
                done = []
                while paths:
                    at, used = paths.pop()
                    if at == len(w):
                        done.append(used)
                        continue
                    paths += [(at + n, (*used, ids[w[at : at + n]])) for n in range(1, len(w) - at + 1) if w[at : at + n] in ids]
                    paths.append((at + 1, (*used, v.byte[w[at]])))
                mass = sum((1 / v.size) ** len(u) for u in done)
                for u in done:
                    for x in u:
                        total[x, k] += (1 / v.size) ** len(u) / mass
    want = (total + langid.PRIOR) / (total + langid.PRIOR).sum(0)
    assert langs == ["x", "y"] and np.allclose(p, want, rtol=1e-8)
    for r in langid.predict(d, langs, p, PIECES).collect():
        if r.text:
            s = sum(brute_forward(langid.marked(x.encode()), ids, v.byte, np.log(p)) for x in r.text.split())
            q = np.exp(s - s.max())
            assert r.lang_pred == langs[int(s.argmax())] and r.score == pytest.approx(q.max() / q.sum(), rel=1e-4)


def test_token_file(spark, tmp_path):
    texts = [" ".join(rnd_words(i, 7 * i)) for i in range(150)] + HARD
    d = docs_of(spark, texts).repartition(5)
    own, at = tokens.Tokens(WORD), 0
    got = {r.doc_id: r for r in tokenfile.digest(tokenfile.round_trip(d, WORD)).collect()}
    for i, t in enumerate(texts):
        ids = np.append(own.encode(*bw.flat(pa.array([t], pa.string())))[0], 1).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    files = tokenfile.write(d, f"file://{tmp_path}/t", WORD)
    f = tokenfile.TokenFile(files[0]["path"])
    whole = f.ids(0, f.tokens)
    assert f.ids(100, 7).tolist() == whole[100:107].tolist() and f.document(1).tolist() == whole[f.starts[1] : f.starts[1] + f.counts[1]].tolist()
    assert tokenfile.round_trip(d.limit(0), WORD).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = tokenfile.packed(x, bits)
    assert len(data) == (1001 * bits + 7) // 8 and tokenfile.unpacked(data, 1001, bits).tolist() == x.tolist()


def test_licenses(spark):
    t = licenses.TEMPLATES
    texts = [" ".join(rnd_words(i, 50)) + " " + x + " " + " ".join(rnd_words(i + 1, 70)) for i, x in enumerate(t.values())]
    texts += [x.upper() for x in t.values()] + ["released under the", "Released under the MIT"] + HARD
    d = docs_of(spark, texts, w=["x"] * len(texts), size=["y"] * len(texts))
    got = collections.defaultdict(dict)
    for r in licenses.scan(d).collect():
        got[r.doc_id][r.license] = r.containment
    words = {n: licenses.template_words(x) for n, x in t.items()}
    for i, x in enumerate(texts):
        w = " " + " ".join(licenses.template_words(x or "")) + " "
        for n, v in words.items():
            if " " + " ".join(v) + " " in w:
                assert got[i].get(n) == 1.0, (n, x[:80])
    assert not any(got[i] for i in range(len(texts) - len(HARD) - 2, len(texts)))
    assert licenses.scan(d.limit(0)).count() == 0


def write_tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what its predecessor kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(4)
    item = " ".join(rnd_words(999, 25, 3000))
    texts, labels = {}, []
    for i in range(150):
        w = rnd_words(i, 80, 3000)
        if i % 10 == 3:
            w = [x + "%%%" for x in w]
        texts[i] = " ".join(w)
        if i % 3:
            labels.append((i, int(i % 10 != 3), 0))
    texts[20] += " " + item
    texts[40] = texts[41] = texts[42]
    texts |= dict(enumerate(["", None, "12 34"], 150))
    d = spark.createDataFrame([(i, t, "en" if i % 2 else None, f"s{r.randrange(3)}", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    write_tables(spark, tmp_path, d, labels, [(1, item)])
    stages, folder, seen = dict(pipeline.STAGES), str(tmp_path), {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality", "language", "near_duplicates", "benchmark"):
        docs = stages[name](spark, docs, folder)
        assert docs.columns == d.columns
        seen[name] = {x.doc_id for x in docs.select("doc_id").collect()}
    good = {i for i, q, t in labels if q and not t}
    weight = brute_importance(texts, sorted(good))
    keys = {x.doc_id: x.gumbel_key for x in importance.weigh(d, importance.fit(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    assert {i: keys[i] > weight[i] - 6 for i in texts} == dict.fromkeys(texts, True)
    best = sorted(texts, key=lambda i: -keys[i])[: round(sum(q for _, q, _ in labels) / len(labels) * len(texts))]
    assert seen["quality"] == set(best) and len(seen["quality"] & {i for i in range(150) if i % 10 == 3}) <= 2
    assert seen["language"] == {i for i in seen["quality"] if texts[i] and any(c.isalpha() for c in texts[i])}
    groups = brute_join([(i, texts[i]) for i in sorted(seen["language"])])
    assert seen["near_duplicates"] == {g for _, g in groups.values()}
    assert seen["benchmark"] == {i for i in seen["near_duplicates"] if not brute_hits(texts[i], [(1, item)])[1]}
    assert {x.doc_id for x in pipeline.run(spark, folder).collect()} == seen["benchmark"]


def test_pipeline_stages_on_hard_tables(spark, tmp_path):
    """Empty tables, null ids, repeated rows, long texts and clashing columns in each stage."""
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["log_weight", "gumbel_key", "_key", "lang_pred", "score", "_guess", "component_id", "_kept", "class", "n", "items", "n_hit", "hits", "n_words", "_row", "w", "found", "_s", "ids"]
    rows = [(i, " ".join(rnd_words(i, 40)), "en") for i in range(20)] + [(None, "a null id here", "en"), (None, None, None), (3, "repeated id with another text", "en"), (5, " ".join(rnd_words(5, 40)), "en"), (30, "long " * 60_000, "en"), (31, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(n) for n in names})
    write_tables(spark, tmp_path, d, [(i, 1, 0) for i in range(20)] + [(None, 1, None)], [(1, "zz yy xx"), (None, None)])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns and all(x[n] == n for x in out.collect() for n in names), name
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0, name
        kept = out.collect()
        if name == "near_duplicates":
            assert sum(x.doc_id == 5 for x in kept) == 1 and sum(x.doc_id is None for x in kept) == 2 and sum(x.doc_id == 3 for x in kept) == 1
        else:
            assert sum(x.doc_id == 5 for x in kept) == 2 and sum(x.doc_id is None for x in kept) == (1 if name == "language" else 2)
    assert pipeline.pack(spark, d, str(tmp_path)).where("doc_id is null").count() >= 2 and pipeline.pack(spark, d.limit(0), str(tmp_path)).count() == 0


def test_stated_cases(spark):
    """Null and equal ids, repeated rows and clashing names where the operators state a result."""
    d = spark.createDataFrame([(None, "one two three four five six"), (None, None), (1, "one two three four five six"), (1, "one two three four five six"), (1, "other words of an equal id")], "doc_id long, text string")
    assert lm.score(d.withColumn("_scored", F.lit("k")), lm.train(d)).select("_scored").distinct().first()[0] == "k"
    assert sum(x.held_out for x in lm.digest(lm.score_held_out(d)).collect()) == 3 * (zlib.crc32(b"1") % 10 == 0)
    prints = winnow.compare_with_edits(d).collect()
    assert len(prints) == 5 and len({x.fingerprint for x in prints if x.n_chars == 27}) == 1
    files = tokenfile.digest(tokenfile.round_trip(d, WORD)).orderBy("start").collect()
    assert [x.doc_id for x in files] == [None, None, 1, 1, 1] and files[0].n_tokens == 1 and sorted(x.start for x in files) == [x.start for x in files]
    told = licenses.scan(spark.createDataFrame([(None, "all rights reserved."), (7, "All rights reserved."), (7, "All rights reserved."), (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files and more words"), (9, "Permission is hereby granted, free of charge, to any person")], "doc_id long, text string"))
    assert sorted((x.doc_id or -1, x.license) for x in told.collect()) == [(-1, "all-rights-reserved"), (7, "all-rights-reserved")]
    t = {"t": "a b c d e f g h i j k l m n"}  # ten shingles
    near = spark.createDataFrame([(1, "x a b c d e f g h i j k l y"), (2, "x a b c d e f g h i j k y")], "doc_id long, text string")
    assert [(x.doc_id, x.containment) for x in licenses.scan(near, templates=t).collect()] == [(1, 0.8)]
    items = spark.createDataFrame([(None, "one two"), (4, "one two")], "item_id long, text string")
    got = {(x.doc_id, x.n_hit, tuple(x["items"])) for x in decontaminate.find(d, items).collect()}
    assert (1, 2, (4,)) in got and (None, 0, ()) in got


def test_many_templates_in_groups(spark, monkeypatch):
    t = {f"t{i}": " ".join(rnd_words(i, 12, 900)) for i in range(8)}
    d = spark.createDataFrame([(i, "x y " + x + " z") for i, x in enumerate(t.values())], "doc_id long, text string")
    whole = sorted(licenses.scan(d, templates=t).collect())
    monkeypatch.setattr(licenses, "MOST", 20)
    assert sorted(licenses.scan(d, templates=t).collect()) == whole and len(whole) == 8


def test_winnowing_finds_what_it_promises():
    """Any K + WINDOW - 1 shared characters give a shared hash, wherever they are; fewer than K give none."""
    r = random.Random(7)
    letters = "abcdefghij kl mnop"
    for i in range(60):
        both = "".join(r.choices(letters, k=winnow.K + winnow.WINDOW - 1))
        a, b = ("".join(r.choices(x, k=r.randrange(300))) + both + "".join(r.choices(x, k=r.randrange(300))) for x in ("ABCDEFGH", "12345678"))
        assert winnow.likeness(np.unique(winnow.winnow(a)[0]), np.unique(winnow.winnow(b)[0])) > 0
        a, b = ("".join(r.choices(x, k=200)) + both[: winnow.K - 1] + "".join(r.choices(x, k=200)) for x in ("ABCDEFGH", "12345678"))
        assert winnow.likeness(np.unique(winnow.winnow(a)[0]), np.unique(winnow.winnow(b)[0])) == 0


def test_shared_folder(spark):
    from newsloom.llm import common

    kept = common.stored(spark.range(3), "x")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    common.dropped(kept)
    assert not __import__("os").path.exists(path.removeprefix("file:").replace("///", "/"))
    again = common.stored(spark.range(3), "y")
    assert again.count() == 3 and common.clear(spark) > 0
    assert common.fresh("a", ["_A", "_a0"]) == "_a1"
