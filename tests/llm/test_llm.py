"""The ten operators and the pipeline against brute force, and on nulls, empty and long texts, ties and clashes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, forest, isomedia, langid, lines, minhash, mixing, paragraphs, suffix, unigram, url_filter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, key string, component string, text_kept string, _gone string, size string, id string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def make_texts(seed=3, n=60):
    """Random prose with copies, near copies, a passage that many share, and odd cases."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(600)]
    passage = " ".join(rng.choices(vocab, k=70))
    out = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(20, 160))
        if i % 5 == 4:
            w = [*w[: len(w) // 2], passage, *w[len(w) // 2 :]]
        t = " ".join(w)
        out.append("\n".join(" ".join(t.split(" ")[k : k + 9]) for k in range(0, len(t.split(" ")), 9)))
    for i in (3, 7, 11):
        near = out[i].split(" ")
        near[len(near) // 2] = "changed"
        out += [out[i], " ".join(near), out[i].upper()]
    return [*out, None, "", " \t\n", "short one", "short one", "a b c d", "x" * 3000, "ü▁é日本🎉 " * 40, "and " * 400, out[0] + "\n" + out[1]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 1, "k", "c", "t", "g", "z", "q") for i, t in enumerate(make_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op1_media_round_trip(docs, empty, spark):
    got = rows_of(isomedia.text_media_features(docs))
    for r in docs.collect():
        raw = (r.text or "").encode()
        pay = isomedia.padded(raw)
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.tail_crc32) == (len(raw), len(pay), zlib.crc32(pay[-64:]))
        assert g.payload_sha256 == hashlib.sha256(pay).hexdigest()
    media = isomedia.encode_media(docs)
    probed = isomedia.probe_media(media.unionByName(spark.createDataFrame([(-1, 0, None), (-2, 0, b"\0\0\0\x63moov")], media.schema))).collect()
    assert {r.doc_id: r.error is None for r in probed if r.doc_id < 0} == {-1: False, -2: False}
    assert all(r.tracks[0].codec == "raw " for r in probed if r.doc_id >= 0)
    assert isomedia.text_media_features(empty).count() == 0


def test_op1_hostile_boxes_are_errors(spark, docs):
    import struct

    stsz = isomedia.box(b"stsz", struct.pack(">III", 0, 1, 0xFFFFFFFF))
    track = lambda *tables: isomedia.box(b"moov", isomedia.box(b"trak", isomedia.box(b"mdia", isomedia.box(b"minf", isomedia.box(b"stbl", *tables)))))
    deep = b""
    for _ in range(3000):
        deep = isomedia.box(b"moov", deep)
    three = isomedia.box(b"stsz", struct.pack(">III3I", 0, 0, 3, 5, 7, 11)), isomedia.box(b"stco", struct.pack(">III", 0, 1, 100))
    wide = track(*three, isomedia.box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 0xFFFFFFFF, 1)))
    zero = track(*three, isomedia.box(b"stsc", struct.pack(">IIIII", 0, 1, 1, 3, 1)), isomedia.box(b"stss", struct.pack(">III", 0, 1, 0)))
    rows = [(1, track(stsz)), (2, deep), (3, wide + bytes(200)), (4, zero), (5, None), (6, b"")]
    got = {r.doc_id: r for r in isomedia.probe_media(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [got[i].error is None for i in range(1, 7)] == [False, False, True, False, False, True]
    assert [(k.start, k.size) for k in got[3].tracks[0].keyframes] == [(100, 5), (105, 7), (112, 11)]
    media = {r.doc_id: bytes(r.media) for r in isomedia.encode_media(docs).collect()}
    for r in isomedia.text_media_features(docs).collect():
        m = media[r.doc_id]
        assert (r.media_bytes, r.media_sha256, r.codec, r.duration) == (len(m), hashlib.sha256(m).hexdigest(), "raw", r.payload_bytes)
        assert b"".join(m[k.start : k.start + k.size] for k in r.keyframes) == b"".join(m[-r.payload_bytes :][i : i + 64] for i in range(0, r.payload_bytes, 1024))


def test_op1_reads_variable_samples():
    import struct

    sizes, chunks = [5, 7, 11], [(100, 2), (300, 1)]
    stbl = isomedia.box(b"stbl", isomedia.box(b"stsz", struct.pack(">III3I", 0, 0, 3, *sizes)), isomedia.box(b"stsc", struct.pack(">II6I", 0, 2, 1, 2, 1, 2, 1, 1)), isomedia.box(b"stco", struct.pack(">II2I", 0, 2, 100, 300)))
    data = isomedia.box(b"moov", isomedia.box(b"trak", isomedia.box(b"mdia", isomedia.box(b"minf", stbl))))
    (track,) = isomedia.probe(data + bytes(400))
    assert track["ranges"].tolist() == [[100, 12], [300, 11]] and chunks
    assert track["keyframes"].tolist() == [[100, 5], [105, 7], [300, 11]]


def test_op2_longest_rule(spark):
    urls = ["http://A.example.com/en/77?x", "https://example.com/en/6", "https://com.org/en/7", "x://b.net/de/8#f", "http://example.net/de/81/", None, "no scheme", "http://", "http://org", "https://sub.org/es/", "http://example.com:80/en/7", ""]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = rows_of(url_filter.filter_urls(pages), "page_id")
    want = ["example.com/en/7", "com/en/", None, "net/de/", "example.net/de/8", None, None, None, None, "org/es/", None, None]
    assert [got[i].rule for i in range(len(urls))] == want
    assert got[0].host == "a.example.com" and got[0].path == "/en/77" and (got[5].host, got[5].path) == ("", "")
    assert [got[i].verdict for i in (0, 1, 2)] == ["allow", "block", "allow"]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_op3_gradients_and_held_out_accuracy(spark):
    rng = np.random.default_rng(1)
    w = langid.Direction.init(rng, 3, "f") | langid.Direction.init(rng, 3, "b") | {"o": rng.normal(size=(6, 2)), "ob": np.zeros(2)}
    x, y = rng.integers(97, 105, (7, 4)), np.array([0, 1, 1, 0])
    _, g = langid.loss_and_gradients(w, x, y, np.ones(4))
    for k in w:
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        w[k][at] += 1e-5
        up, _ = langid.loss_and_gradients(w, x, y, np.ones(4))
        w[k][at] -= 2e-5
        down, _ = langid.loss_and_gradients(w, x, y, np.ones(4))
        w[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-7
    r = random.Random(5)
    text = lambda sounds: " ".join("".join(r.choices(sounds, k=3)) for _ in range(r.randint(8, 120)))
    sounds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["sch", "ein", "ung", "ber"]}
    rows = [(i, text(sounds[("xx", "yy")[i % 2]]), ("xx", "yy")[i % 2], "s") for i in range(400)]
    rows += [(1000, None, "xx", "s"), (1001, "", None, "s"), (1002, "123 !?", "yy", "s"), (1003, rows[0][1] * 60, None, None), (None, "kato", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "xx"
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 400]
    assert held and all(zlib.crc32(str(g.doc_id).encode()) % 4 == 2 for g in held)
    assert np.mean([g.lang_pred == ("xx", "yy")[g.doc_id % 2] for g in held]) > 0.95
    assert langid.identify(df.limit(0)).count() == 0
    assert {g.lang_pred for g in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op3_inference_equals_the_training_pass():
    rng = np.random.default_rng(3)
    w = langid.Direction.init(rng, 5, "f") | langid.Direction.init(rng, 5, "b") | {"o": rng.normal(size=(10, 3)), "ob": rng.normal(size=3)}
    w |= {"fb": rng.normal(size=5), "bb": rng.normal(size=5)}

    def told(x):
        """Probabilities (time, rows, languages) by the pass that training uses, in double precision."""
        f, b = langid.Direction.forward(w, "f", x)[0], langid.Direction.forward(w, "b", x[::-1])[0][::-1]
        e = np.exp(np.concatenate([f, b], axis=2) @ w["o"] + w["ob"])
        return e / e.sum(axis=2, keepdims=True)

    reader = langid.Reader({k: v.astype(np.float32) for k, v in w.items()})
    x = rng.integers(0, 256, (17, 9))
    assert np.abs(reader.positions(x).transpose(0, 2, 1) - told(x)).max() < 1e-5
    size = 8
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 7, 8, 9, 15, 16, 17, 100, 3)]
    want = []
    for t in texts:
        logs = []
        for k in range(-(-len(t) // size)):
            at = max(min(k * size, len(t) - size), 0)
            piece = np.frombuffer(t[at : at + size].ljust(size, b" "), np.uint8)[:, None]
            logs += [np.log(p + 1e-6) for i, p in enumerate(told(piece)[:, 0]) if k * size <= at + i < len(t)]
        assert len(logs) == len(t)  # every position counts once
        e = np.exp(np.mean(logs, axis=0)) if logs else np.ones(3)
        want.append(e / e.sum())
    for rows in (1, 3, 1024):
        assert np.abs(reader.documents(texts, size, rows) - np.array(want)).max() < 1e-5


def test_op3_learns_every_labelled_language(spark):
    rows = [(i, f"some words {i}", f"l{i % 150:03}") for i in range(1500)]
    _, labels, langs = langid.sample_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False), sample=640)
    assert langs == sorted({r[2] for r in rows}) and set(labels.tolist()) == set(range(150))
    assert len(labels) == 1500


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("tight", [False, True])
def test_op4_components(docs, empty, monkeypatch, tight):
    if tight:
        monkeypatch.setattr(minhash, "BLOCK", 3)
    got = rows_of(minhash.near_duplicates(docs))
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = groups(sets)
    assert {d: (g.n_shingles, g.component_id, g.kept) for d, g in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in sets}
    assert minhash.near_duplicates(empty).count() == 0


def test_op4_one_large_group_of_near_copies(spark):
    """Members whose least document is no neighbour of theirs still meet, in place where pairs abound."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6))):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups({i: shingles(t) for i, t in rows})
    assert {d: g.component_id for d, g in rows_of(minhash.near_duplicates(df)).items()} == want


def test_components_of_paths_and_structs(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(7, 7), (3, 1), (None, 4)]
    e = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.id: r.component for r in components.components(e).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}
    s = e.select(F.struct(F.lit(1).alias("x"), F.col("a").alias("y")).alias("a"), F.struct(F.lit(1).alias("x"), F.col("b").alias("y")).alias("b")).filter("a.y is not null")
    assert {r.id.y: r.component.y for r in components.components(s).collect()} == got
    assert components.components(e.limit(0)).count() == 0


def test_op5_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1200, 16)) * rng.uniform(0.5, 2, (1200, 1))
    rows = [(i, [float(x) for x in v[i]]) for i in range(1200)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0]), (1, [float(x) for x in v[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = defaultdict(list)
    for r in forest.search(df, F.col("vec_id") % 20 == 0, shard_rows=400, query_rows=25).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(range(0, 1200, 20)) and all(len(g) == 20 for g in got.values())
    hits = 0
    for q, g in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r.vec_id for r in g})
        assert q not in {r.vec_id for r in g} and [r.rank for r in g] == list(range(1, 21))
        assert all(abs(r.score - v[q] @ v[r.vec_id]) < 1e-9 for r in g if r.vec_id != 1)
    assert hits / (20 * len(got)) >= 0.9
    assert forest.nearest(df.limit(0)).count() == 0
    two = forest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0, 2.0]), (21, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")).orderBy("query_id").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in two] == [(0, 1, 0.5), (20, 21, 2.0)]  # either dimension by itself
    few = forest.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [1, 2]


def test_op5_equal_vectors_get_equal_scores(spark):
    """Copies spread over shards: their scores agree to the last bit, so ties fall to the smaller id."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(600, 64))
    v[495:] = v[rng.integers(0, 20, 105)]
    ids = rng.permutation(6000)[:600]
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>").repartition(5)
    of = {int(i): x for i, x in zip(ids, v)}
    got = defaultdict(list)
    for r in forest.search(df, F.col("vec_id") % 9 == 0, shard_rows=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert len(got) > 40
    for q, found in got.items():
        score = {}
        for r in found:
            assert score.setdefault(of[r.vec_id].tobytes(), r.score) == r.score
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)


def test_op5_recall_on_the_shipped_vectors(spark):
    for size in ("sf0.001", "sf0.01"):
        df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
        rows = sorted((r.vec_id, r.embedding) for r in df.collect())
        ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
        got = defaultdict(set)
        for r in forest.nearest(df).collect():
            got[r.query_id].add(r.vec_id)
        hits = 0
        for i in np.flatnonzero(ids % 20 == 0):
            s = v @ v[i]
            s[i] = -np.inf
            hits += len(got[ids[i]] & set(ids[np.argsort(-s)[:20]].tolist()))
        assert hits >= 0.9 * 20 * len(got), size


def test_op4_polynomial_collisions_stay_apart(spark):
    """Thue-Morse words, whose polynomial values modulo 2**64 agree for every base, are different words."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    got = rows_of(minhash.near_duplicates(spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")))
    assert [(got[i].component_id, got[i].kept) for i in (1, 2, 3)] == [(1, True), (2, True), (2, False)]


def test_op4_null_and_repeated_ids(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    a, b, c = say(40), say(40), say(40)
    near = b.rsplit(" ", 2)[0] + " other end"
    rows = [(1, a), (2, a), (2, b), (3, near), (None, a), (4, c), (4, c), (5, None), (None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 36, 1, True), (2, 36, 1, False), (2, 36, 1, False), (3, 36, 1, False), (0, 36, None, True), (4, 36, 4, True), (4, 36, 4, True), (5, 0, 5, True), (0, 0, None, True)], key=lambda x: (x[0], x[1]))


def test_op9_the_budget_cuts_the_queue(spark):
    """The mix is the whole queue up to its budget: the next copy in virtual time would not fit, whatever its source."""
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(1, 60), f"s{rng.choice((0, 0, 0, 1, 2, 3))}") for i in range(400)] + [(None, "w w", "s0"), (7, "w " * 9, "s0")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total, taken = sum(r["size"] for r in got), sum(r.taken for r in got)
    assert len(got) == len(rows) and abs(taken - total) <= max(r["size"] for r in got) / 2
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r.source_size][0] += r.taken
        per[r.source_size][1] = r.target
    assert any(t > target for t, target in per.values())  # a cut for each source alone would never pass its target


def test_op6_colliding_hashes_and_dotted_names(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(lines.F, "xxhash64", lambda *a: F.pmod(real(*a), F.lit(2)))
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "e\nf\ng\nh"), (3, "e\nf\ng\nh"), (4, "a\nb\nc\nd")], "doc_id long, `te.xt` string")
    got = rows_of(lines.dedup_lines(df, text="te.xt", mean=1 << 30))
    assert {d: g.chunks_removed for d, g in got.items()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_op6_line_chunks(docs, empty):
    got = rows_of(lines.dedup_lines(docs))
    first, want = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text is None:
            want[r.doc_id] = (None, 0)
            continue
        ls = r.text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
        kept, n, now = [], 0, []
        for i, x in enumerate(ls):
            now.append(x)
            if i == len(ls) - 1 or (h[i] * 31 + (h[i - 1] if i else 0)) % lines.MEAN == 0:
                body = "\n".join(now)
                gone = len(now) >= lines.LEAST and body in first
                if len(now) >= lines.LEAST:
                    first.setdefault(body, r.doc_id)
                n += gone
                kept += [] if gone else [body]
                now = []
        want[r.doc_id] = ("\n".join(kept), n)
    assert {d: (g.text_kept, g.chunks_removed) for d, g in got.items()} == want
    assert sum(n for _, n in want.values()) > 0
    assert lines.dedup_lines(empty).count() == 0 and got[0]._gone == "g"


def test_op7_best_paths_and_round_trip(docs, empty, spark):
    v = unigram.load_vocabulary()
    enc = unigram.encode(docs)
    got, back = rows_of(enc), rows_of(unigram.decode(enc))
    for r in docs.collect():
        assert back[r.doc_id].text == r.text and got[r.doc_id].exact == (None if r.text is None else True)
        assert got[r.doc_id].n_pieces == len(got[r.doc_id].ids or [])
    assert unigram.encode(empty).count() == 0
    odd = unigram.decode(spark.createDataFrame([(1, [None, 10**6, -4]), (2, None)], "doc_id long, ids array<int>"))
    assert {r.doc_id: r.text for r in odd.collect()} == {1: "", 2: None}
    pieces = {v.spell[a:b].tobytes(): s for a, b, s in zip(v.spell_at, v.spell_at[1:], v.score) if b > a and s < 0}
    worst = v.score.min() - unigram.UNKNOWN_PENALTY
    byte_of = {int(i): b for b, i in enumerate(v.byte_id)}
    draw = random.Random(5)
    texts = ["hello world", "naïve  café", "zzzzqqq unfathomably", "\ue000", "a\ue000\U0001f9ffb", "▁▁ x▁", " \ue001 \ue001"]
    texts += ["".join(draw.choices("aeinrst  ßé中\ue000\U0010fffd▁\x01", k=draw.randint(1, 25))) for _ in range(80)]
    fallen = 0
    for text in texts:
        u = b" " + text.encode()
        best = [0.0] + [-1e18] * len(u)
        for i in range(len(u)):
            if (u[i] & 0xC0) == 0x80:
                continue
            w = 1
            while i + w < len(u) and (u[i + w] & 0xC0) == 0x80:
                w += 1
            for e in range(i + 1, len(u) + 1):
                if (s := pieces.get(u[i:e])) is not None:
                    best[e] = max(best[e], best[i] + s)
            if u[i : i + w] not in pieces:
                best[i + w] = max(best[i + w], best[i] + worst)
        ids, _ = unigram.encode_block(v, [text.encode()])
        score, at = 0.0, 0
        while at < len(ids):
            lead = byte_of.get(int(ids[at]))
            if lead is None:
                score, at = score + v.score[ids[at]], at + 1
                continue
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4  # a character's bytes, one penalty
            char = bytes(byte_of[int(i)] for i in ids[at : at + width])
            assert len(char.decode()) == 1 and char not in pieces
            score, at, fallen = score + worst, at + width, fallen + 1
        assert abs(score - best[-1]) < 1e-6, text
        assert unigram.decode_block(v, ids, np.array([len(ids)])) == [text.encode()]
    assert fallen > 100


def removed_by_windows(texts, length=50):
    first, out = {}, {}
    for d in sorted(texts):
        b = texts[d]
        cov = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i : i + length], d) < d:
                cov[i : i + length] = b"\1" * length
        out[d] = cov
    return out


@pytest.mark.parametrize("many", [4096, 1])
def test_op8_windows(docs, empty, monkeypatch, many):
    monkeypatch.setattr(suffix, "MANY", many)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = rows_of(suffix.removal_digest(docs))
    for d, cov in removed_by_windows(texts).items():
        kept = bytes(x for x, c in zip(texts[d], cov) if not c)
        spans = sum(1 for i, c in enumerate(cov) if c and (i == 0 or not cov[i - 1]))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(cov), sum(cov), spans, hashlib.sha256(kept).hexdigest()), d
    assert suffix.dedup_substrings(empty).count() == 0


def test_op8_colliding_hashes_remove_nothing(spark, monkeypatch):
    """Windows and spans whose kept hashes collide are not taken for repeats: bytes, or the second hash, decide."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    common, twice = say(45), say(80)
    rows = [(i, say(60) + common + say(60)) for i in range(300)] + [(300, twice), (301, twice)]
    texts = {i: t.encode() for i, t in rows}

    class Narrow(suffix.Runs):
        def __init__(self, texts, length):
            super().__init__(texts, length)
            if len(self.doc):
                self.span = self.span & np.uint64(3)
                self.key = self.key & np.uint64(7)
                of = self.hashes.of
                self.hashes.of = lambda a, b: of(a, b) & np.uint64(15)

    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {d: sum(cov) for d, cov in removed_by_windows(texts).items()}
    monkeypatch.setattr(suffix, "Runs", Narrow)
    for many in (4096, 1):
        monkeypatch.setattr(suffix, "MANY", many)
        assert {d: g.n_removed for d, g in rows_of(suffix.removal_digest(df)).items()} == want
    assert sum(want.values()) == len(twice)


def test_op8_suffix_order():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 400).astype(np.uint8)
    h = suffix.PrefixHashes(raw)
    starts, group = np.arange(340), np.arange(340) % 3
    order = suffix.suffix_sort(h, starts, group, 60)
    text = raw.tobytes()
    assert order.tolist() == sorted(range(340), key=lambda i: (group[i], text[i : i + 60], i))


def test_op9_targets_and_budget(docs, empty):
    got = rows_of(mixing.mix(docs))
    size = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    src = {r.doc_id: r.source for r in docs.collect()}
    assert {d: g["size"] for d, g in got.items()} == size
    total = defaultdict(int)
    for d, n in size.items():
        total[src[d]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    longest = max(size.values())
    for s in names:
        taken = sum(g.taken for d, g in got.items() if src[d] == s)
        assert abs(taken - target[s]) <= longest and all(abs(got[d].target - target[s]) < 1e-6 for d in got if src[d] == s)
    assert all(g.taken <= 3 * g["size"] and (g["size"] == 0 or g.taken % g["size"] == 0) for g in got.values())
    assert rows_of(mixing.mix(docs.repartition(3), slice_rows=7)) == got
    assert mixing.mix(empty).count() == 0


def test_op10_repeated_passages(docs, empty):
    got = rows_of(paragraphs.dedup_paragraphs(docs))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for d, g in got.items():
        kept, at = b"", 0
        for s in g.spans:
            kept += texts[d][at : s.start]
            at = s.end
        assert kept + texts[d][at:] == bytes(g.kept)
    first = defaultdict(list)
    for d in sorted(texts):
        w = texts[d].decode().translate(LOWER).split()
        for i in range(len(w) - 50):
            first[tuple(w[i : i + 51])].append(d)
    need = {d for ds in first.values() for d in ds if d > ds[0]}
    touched = {d for d, g in got.items() if g.spans}
    assert need and len(need & touched) >= 0.95 * len(need)
    shared = {x for x, ds in _windows(texts).items() if len(ds) > 1}
    whole = {d: tuple(words(texts[d].decode())) for d in texts}
    copies = {d for d, w in whole.items() if w and any(whole[e] == w for e in texts if e < d)}
    clean = {d for d in texts if not any(x in shared for x in _own(texts[d]))} - copies
    assert clean and not clean & touched
    assert all(not words(bytes(got[d].kept).decode()) for d in copies)
    assert paragraphs.dedup_paragraphs(empty).count() == 0


def test_op10_exact_copies_of_any_length_and_wording(spark):
    licence = "\n\n".join(f"clause {i} of it" for i in range(200))
    texts = ["and " * 400, "na na hey " * 200, "one two three four five six seven", licence, "word", "Other  Words\there"]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, texts[5].lower().replace("\t", " ")])]
    for parts in (1, 4):
        got = rows_of(paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)))
        for d, t in rows:
            left = words(bytes(got[d].kept).decode())
            assert (left == words(t) and not got[d].spans) if d < len(texts) else not left, d


def test_op10_paragraphs_against_brute_force(spark):
    """Every paragraph, whole or cut as stated, goes if a chain of links at the threshold leads to a smaller document."""
    rng = random.Random(21)
    vocab = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    pool = [rng.choices(vocab, k=n) for n in (3, 4, 12, 30, 30, 60, 90, 140)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(pool)) if rng.random() < 0.5 else rng.choices(vocab, k=rng.randint(1, 50))
            if rng.random() < 0.3:
                w[rng.randrange(len(w))] = "edit"
            parts.append(" ".join(w))
        rows.append((i, "\n\n".join(parts)))
    items = {}
    for d, t in rows:
        p = paragraphs.Paragraphs([t.encode()], paragraphs.Shingler(paragraphs.WIDTH))
        at = 0
        for para in t.split("\n\n"):  # the rule for cuts, from its statement
            h = paragraphs.Shingler(paragraphs.WIDTH).words([para.encode()])[0].tolist()
            r = paragraphs.RADIUS
            cuts = [0] + [k for k in range(r, len(h) - r) if h[k] < min(h[k - r : k]) and h[k] <= min(h[k + 1 : k + r + 1])] + [len(h)]
            spots = [m.span() for m in re.finditer(r"\S+", para)]
            for x, y in {*zip(cuts, cuts[1:]), (0, len(h))}:
                items[(d, at + spots[x][0], at + spots[y - 1][1])] = shingles(para[spots[x][0] : spots[y - 1][1]])
            at += len(para) + 2
        assert {(a, z) for a, z in zip(p.first.tolist(), p.last.tolist())} == {k[1:] for k in items if k[0] == d}
    want = defaultdict(set)
    for k, c in groups(items).items():
        if c[0] != k[0]:
            want[k[0]] |= set(range(k[1], k[2]))
    got = rows_of(paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    have = {d: {x for s in g.spans for x in range(s.start, s.end)} for d, g in got.items()}
    assert all(have[d] <= want[d] for d in have)  # bands may miss a pair at the threshold, but none is invented
    assert sum(map(len, have.values())) >= 0.98 * sum(map(len, want.values())) > 0


@pytest.mark.parametrize("dedup", [suffix.dedup_substrings, paragraphs.dedup_paragraphs])
def test_op8_op10_null_and_repeated_ids(spark, dedup):
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    a, b = say(40), say(40)
    rows = [(1, a), (2, a), (2, a), (2, "z" + b), (None, a), (None, None), (3, b), (4, None), (4, None), (5, "é" * 5000 + a)]
    got = sorted((r.doc_id or 0, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.kept)) for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(a)
    tail = 0 if dedup is paragraphs.dedup_paragraphs else n
    assert [g for g in got if g[0] < 5] == sorted([(1, n, 0, n), (2, n, n, 0), (2, n, n, 0), (2, n + 1, 0, n + 1), (0, n, 0, n), (0, 0, 0, 0), (3, n, 0, n), (4, 0, 0, 0), (4, 0, 0, 0)])
    assert got[-1][:2] == (5, 10000 + n) and got[-1][2] >= tail


def _pieces(block):
    p = paragraphs.Paragraphs(block, paragraphs.Shingler(paragraphs.WIDTH))
    return {d: [(a, z) for i, a, z in zip(p.doc.tolist(), p.first.tolist(), p.last.tolist()) if i == d] for d in range(len(block))}


def test_op10_cuts_do_not_depend_on_other_texts(spark):
    """Exact copies of 8 to 30 words among other neighbours: alone, in other blocks, in other partitionings."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    short = [say(n) for n in range(8, 31) for _ in range(4)]
    alone = {t: _pieces([t.encode()])[0] for t in short}
    for _ in range(3):
        block = [x.encode() for t in short for x in (say(rng.randint(1, 40)), t)]
        got = _pieces(block)
        assert [got[2 * i + 1] for i in range(len(short))] == [alone[t] for t in short]
        joined = _pieces([f"{say(9)}\n\n{t}\n\n{say(9)}".encode() for t in short])
        inside = [[(a - 55, z - 55) for a, z in joined[i] if 55 <= a < 55 + len(t)] for i, t in enumerate(short)]
        assert inside == [alone[t] for t in short]
    rows = [(i, t) for i, t in enumerate(x for t in short for x in (t, say(rng.randint(1, 40))))]
    rows += [(1000 + i, t) for i, t in enumerate(rng.sample(short, len(short)))]
    texts = dict(rows)
    for parts in (1, 3, 7):
        got = rows_of(paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)))
        for d, g in got.items():
            cut = {i for a, z in alone.get(texts[d], ()) for i in range(a, z)} if d >= 1000 else set()
            assert cut <= {i for s in g.spans for i in range(s.start, s.end)} and (d >= 1000 or not g.spans), d


def test_near_components_of_items_that_share_cores(spark):
    """Many items hold the same core beside a few words of their own, near each other or not: all links between
    different sets are found, as by brute force over all pairs."""
    rng = np.random.default_rng(5)
    cores = [[f"c{k}w{i}" for i in range(9 + 2 * k)] for k in range(4)]
    texts = []
    for i in range(400):
        core = cores[rng.integers(4)]
        lead = [f"o{rng.integers(0, 6 if i % 2 else 10**6)}" for _ in range(rng.integers(0, 5))]
        texts.append(" ".join([*lead, *core[rng.integers(0, 2) : len(core) - rng.integers(0, 2)]]))
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    p = minhash.Params(bands=96, rows=2)
    got = {r.id: r.component for r in minhash.near_components(items, p, unique=True, rarest=True).collect()}
    plain = {r.id: r.component for r in minhash.near_components(items, p, unique=True).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert got == dict(enumerate(root)) == plain
    assert 4 < len(set(root)) < 400


def test_op10_whole_paragraphs_at_the_threshold(spark):
    """Near copies of whole paragraphs of any length, inside differing texts or alone, go by exact Jaccard similarity."""
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    rows, want = [], {}
    for n, edits in ((60, 1), (100, 2), (200, 4), (8, 0), (9, 0), (13, 0), (30, 0), (60, 4)) * 6:
        base, copy = (w := say(n)), list(w)
        for k in range(edits):
            copy[(2 * k + 1) * n // (2 * edits)] = f"edit{k}"
        a, b = shingles(" ".join(base)), shingles(" ".join(copy))
        alone = len(rows) % 4 == 0
        text, head = " ".join(copy), "" if alone else " ".join(say(20)) + "\n\n"
        rows.append((len(rows), " ".join(base) if alone else " ".join(say(25)) + "\n\n" + " ".join(base) + "\n\n" + " ".join(say(12))))
        rows.append((len(rows), head + text + ("" if alone else "\n\n" + " ".join(say(15)))))
        want[len(rows) - 1] = (len(head), len(head) + len(text), 100 * len(a & b) >= 75 * len(a | b))
    assert {ok for *_, ok in want.values()} == {True, False}
    got = rows_of(paragraphs.dedup_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    caught = 0
    for d, g in got.items():
        spans = [(s.start, s.end) for s in g.spans]
        if d not in want:
            assert not spans
        elif want[d][2]:
            caught += spans == [want[d][:2]]
        else:
            assert spans != [want[d][:2]] and all(want[d][0] <= s and e <= want[d][1] for s, e in spans)
    assert caught >= 0.95 * sum(ok for *_, ok in want.values())


def _own(b, n=6):
    w = b.decode().translate(LOWER).split()
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def _windows(texts):
    out = defaultdict(set)
    for d, b in texts.items():
        for x in _own(b):
            out[x].add(d)
    return out


def test_pipeline_stages(docs, empty, spark):
    import corpus_pipeline as P

    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    given = docs
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        out = stage(spark, given, "").cache()
        assert out.columns == docs.columns
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, rows_of(given)
        assert ids <= set(before)
        if k == 0:
            assert set(before) - ids == {d for d, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")}
        if k == 2:
            want = groups({d: shingles(r.text) for d, r in before.items()})
            assert ids == {d for d, c in want.items() if c == d}
        if k == 3:
            taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(given).collect() if r["size"]}
            times = defaultdict(int)
            for r in out.select("doc_id").collect():
                times[r.doc_id] += 1
            assert dict(times) == {d: n for d, n in taken.items() if n}
        given = out
    last = P.STAGES[4][1](spark, given, "").collect()
    assert len(last) == given.count() and all(r.exact for r in last)
    nothing = empty
    for _, stage in P.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0


def test_pipeline_language_stage_uses_the_network(docs, spark, monkeypatch):
    import corpus_pipeline as P

    lettered = {r.doc_id for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")}
    ids = lambda df: {r.doc_id for r in P.identify_language(spark, df, "").select("doc_id").collect()}
    assert ids(docs.withColumn("lang", F.lit(None).cast("string"))) == lettered  # nothing to learn from
    rng = np.random.default_rng(1)
    w = langid.Direction.init(rng, 3, "f") | langid.Direction.init(rng, 3, "b") | {"o": np.zeros((6, 3)), "ob": np.zeros(3)}
    monkeypatch.setattr(langid, "fit", lambda *a, **b: (w, ["xx", "yy", "zz"]))
    assert ids(docs) == set()  # each language as likely as any other
    w["ob"][1] = 5.0
    assert ids(docs) == lettered
