"""Sequenced changes, repeated passages and spelling variants against brute force."""

import collections
import datetime as dt
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from newsloom.llm import changes, repeats, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


# ---- op 11 -----------------------------------------------------------------------------------------------------------


def brute_changes(rows, batches=8, wait=5, lost=11):
    rows = list({tuple(r) for r in rows})
    seqs = collections.defaultdict(set)
    for r in rows:
        seqs[r[1]].add((r[2] is not None, r[2] or 0))
    rank = {(c, *s): i + 1 for c, ss in seqs.items() for i, s in enumerate(sorted(ss))}
    by = collections.defaultdict(list)
    for change, client, seq, op, at, _, _, city, balance in rows:
        if change is None or at is None or zlib.crc32(str(change).encode()) % lost == 0:
            continue
        day = (at.date() - dt.date(1970, 1, 1)).days + 2 * (zlib.crc32(str(change).encode()) % 4)
        by[max(1, min(batches, 1 + math.floor((day - 19723) * batches / 160)))].append((day, change, client, rank[client, seq is not None, seq or 0], op, city, balance))
    following, held, now, final, out = collections.defaultdict(lambda: 1), collections.defaultdict(dict), {}, {}, {}

    def pop(client, batch, missed=0):
        while following[client] in held[client]:
            _, change, _, _, op, city, balance = held[client].pop(following[client])
            old = now.get(client, (None, None))
            city, balance = {"I": (city, balance), "U": (city if city is not None else old[0], balance if balance is not None else old[1]), "D": (None, None)}.get(op, old)
            now[client], final[client] = (city, balance), (change, op)
            out[change] = [change, client, "applied", batch, missed, city, None if balance is None else math.floor(100 * balance + 0.5), False]
            following[client] += 1
            missed = 0

    clock = -math.inf
    for b in range(1, batches + 2):
        for client in list(held):
            while held[client] and (b > batches or min(r[0] for r in held[client].values()) + wait <= clock):
                least = min(held[client])
                missed, following[client] = least - following[client], least
                pop(client, b, missed)
        for r in sorted(by[b], key=lambda r: r[:2]):
            if r[3] < following[r[2]] or r[3] in held[r[2]]:
                out[r[1]] = [r[1], r[2], "rejected", b, 0, None, None, False]
            else:
                held[r[2]][r[3]] = r
                pop(r[2], b)
        clock = max([clock, *(r[0] for r in by[b])])
    for change, op in final.values():
        out[change][7] = op != "D"
    return out


def some_changes(seed, n=400):
    r = random.Random(seed)
    begin = dt.datetime(2024, 1, 1)
    rows, seq = [], collections.Counter()
    for i in range(n):
        client = r.choice([None, 1, 1, 1, 1, 2, 3, 4, r.randrange(20)])
        seq[client] += r.choice([0, 1, 1, 1, 2])
        at = None if r.random() < 0.03 else begin + dt.timedelta(days=i * 125 / n + r.choice([0, 0, 0, 9, 30, -20]), hours=r.randrange(24))
        rows.append((i, client, seq[client] if r.random() > 0.02 else None, r.choice(["I", "U", "U", "U", "D", None, "X"]), at, "s", None, r.choice([None, "a", "b"]), r.choice([None, 1.005, -2.5, 10.0, r.random() * 100])))
    rows += r.sample(rows, 30)
    rows += [(None, 1, 3, "I", begin, "s", None, "c", 1.0)]
    return rows


@pytest.mark.parametrize("chunk", [3, 20_000])
def test_changes(spark, chunk):
    rows = some_changes(chunk)
    d = spark.createDataFrame(rows, CHANGE).selectExpr("*", "'x' AS n", "1 AS day", "2 AS batch", "3 AS h")
    got = changes.apply(d, chunk=chunk).collect()
    want = brute_changes(rows)
    assert len(got) == len(want) and {r.change_id: list(r) for r in got} == want
    assert any(v[4] for v in want.values()) and any(v[2] == "rejected" for v in want.values())


@pytest.mark.parametrize("group, listed", [(3, 2), (100, 0)])
def test_changes_of_clients_that_share_a_key(spark, group, listed):
    """Clients in groups, their held rows in the value or, beyond a few, in the map."""
    rows = some_changes(group)
    got = changes.apply(spark.createDataFrame(rows, CHANGE), chunk=40, group=group, listed=listed).collect()
    want = brute_changes(rows)
    assert len(got) == len(want) and {r.change_id: list(r) for r in got} == want


def test_changes_of_few(spark):
    begin = dt.datetime(2024, 1, 1)
    none = spark.createDataFrame([], CHANGE)
    assert changes.apply(none, batches=1).count() == 0
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 11][:3]
    rows = [(i, 5, 10 * k, "I", begin, None, None, "c", float("nan") if k else 1e3) for k, i in enumerate(ids)]
    got = sorted(changes.apply(spark.createDataFrame(rows, CHANGE), batches=2).collect(), key=lambda r: r.change_id)
    assert [(r.status, r.batch, r.cents, r.current) for r in got] == [("applied", 1, 100_000, False), ("applied", 1, None, False), ("applied", 1, None, True)]


def test_dense_ranks(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, *range(40)]), "U", None, None, None, None, None) for i in range(500)]
    got = {x.change_id: x.n for x in changes.numbered(spark.createDataFrame(rows, CHANGE)).collect()}
    by = collections.defaultdict(set)
    for x in rows:
        by[x[1]].add(-1 if x[2] is None else x[2])
    assert got == {x[0]: sorted(by[x[1]]).index(-1 if x[2] is None else x[2]) + 1 for x in rows}


# ---- op 12 -----------------------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1 if i is not None else 0):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1 if i is not None else 0):
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_texts(seed, window):
    r = random.Random(seed)
    fresh = lambda n: [f"{r.choice('abcdé')}{r.randrange(90)}" for _ in range(n)]
    shared = [fresh(r.randrange(window - 3, 4 * window)) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = []
        for _ in range(r.randrange(1, 4)):
            w += fresh(r.randrange(0, 2 * window))
            p = list(r.choice(shared))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "other"
            w += p[r.randrange(3) :]
        texts.append(r.choice([" ", "\n", " \t "]).join(w))
    texts += [texts[3], texts[3].replace("\n", " "), texts[4], "a " * 5 * window, "a " * 3 * window, " ".join(["x", "y"] * window), "", None, " \n ", "q" * 100_000, " ".join(fresh(window - 1)), " ".join(shared[0][:window]), "é " * window]
    return list(enumerate(texts))


@pytest.mark.parametrize("window, gram, limit, together", [(50, 12, 1 << 15, 1 << 21), (8, 3, 6, 40), (8, 8, 10**6, 1), (6, 1, 0, 1)])
def test_repeats(spark, window, gram, limit, together):
    rows = some_texts(window + gram, window)
    rows += [(None, rows[2][1]), (7, rows[9][1]), (7, rows[7][1]), (1000, rows[0][1] + " end")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS sha", "1 AS g", "2 AS start", "3 AS n_words").repartition(3)
    found = repeats.find(d, window, gram, limit, together)
    assert sorted((tuple(r) for r in repeats.digest(found).collect()), key=repr) == brute_repeats(rows, window)
    for r in found.collect():
        assert sum(s.length for s in r.spans) == r.n_removed and all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_repeats_of_nothing(spark):
    assert repeats.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_names_of_nodes():
    r = np.random.default_rng(1)
    words = r.integers(0, 2, 3000).astype(np.uint64)
    for window in (1, 2, 5, 8, 13, 50):
        starts = np.arange(len(words) - window + 1)
        name = repeats.names(words, starts, window)
        grams = [tuple(words[i : i + window]) for i in starts]
        rank = {g: i for i, g in enumerate(sorted(set(grams)))}
        assert [rank[g] for g in grams] == name.tolist()


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(2)
    words = np.concatenate([r.integers(0, 5, 300), r.integers(0, 5, 300)]).astype(np.uint64)
    words[400:480] = words[100:180]
    starts = np.arange(len(words) - 49)
    at, g = repeats.anchors(words, starts, 50, 12)
    assert all(a - s == min(range(39), key=lambda k: (g[s + k], k)) for s, a in zip(starts.tolist(), at.tolist()))
    assert ((at - starts)[400:431] == (at - starts)[100:131]).all()


# ---- op 13 -----------------------------------------------------------------------------------------------------------


def brute_spelling(rows, least_length=6, least_count=5, times=5):
    count = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    n = {w: k for w, k in count.items() if len(w) >= least_length and k >= least_count}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        if by[w]:
            best = min(by[w], key=lambda v: (-n[v], v))
            if n[best] >= times * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(by[w]), n.get(form.get(w))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_count, times, held", [(5, 5, 1 << 20), (1, 2, 3)])
def test_spelling(spark, least_count, times, held, monkeypatch):
    r = random.Random(least_count)
    base = ["".join(r.choices("abÀéÿz", k=r.randrange(5, 9))) for _ in range(12)] + ["aaaaaa", "aaaaaaa", "b" * 3000, "b" * 3001, "abcdef", "abcdeff"]
    words = []
    for k, w in enumerate(base):
        words += [w] * r.choice([1, 8, 60, 400])
        for _ in range(3):
            i, c = r.randrange(len(w)), r.choice("abÀé")
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])] * r.choice([1, 5, 12, 70])
    r.shuffle(words)
    rows = [(i, r.choice([" ", "-", "1", "Ā"]).join(w.upper() if r.random() < 0.2 and w.isascii() else w for w in words[i::40])) for i in range(40)]
    rows += [(None, "abcdef abcdef"), (3, None), (4, ""), (5, rows[5][1]), (6, "12 %")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "2 AS key")
    monkeypatch.setattr(spelling, "HELD", held)
    got = spelling.group(d, least_count=least_count, times=times)
    want = brute_spelling(rows, 6, least_count, times)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want
    assert sum(v is not None for _, v, *_ in want) > 3


def test_spelling_of_nothing(spark):
    assert spelling.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    flushed = spelling.vocabulary(spark.createDataFrame([(1, "abcdef abcdeg abcdeh"), (2, "abcdef")], "doc_id long, text string").coalesce(1), 6, 1, held=1)
    assert {(x.word, x.n) for x in flushed.collect()} == {("abcdef", 2), ("abcdeg", 1), ("abcdeh", 1)}


def test_roots_of_long_chains(spark):
    rows = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"v{i}", "w0") for i in range(50)] + [("a", "b")]
    got = {x.word: x.root for x in spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()}
    assert got == {**{w: "w37" for w, _ in rows[:-1]}, "a": "b"}


def test_keys_are_those_of_strings():
    words = ["aabbc", "é", "x" * 40, "", "abc", "abd"]
    own, less, of = spelling.deletion_keys([*words, "abbc", "ab"])
    by = dict(zip([*words, "abbc", "ab"], own.tolist()))
    assert len(set(by.values())) == len(by)
    got = {(int(o), int(k)) for o, k in zip(of, less)}
    assert (0, by["abbc"]) in got and (4, by["ab"]) in got and (5, by["ab"]) in got and (1, by[""]) in got and len([1 for o, _ in got if o == 0]) == 3
