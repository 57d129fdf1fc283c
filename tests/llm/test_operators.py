"""Edge cases and brute-force comparisons on small fixtures."""

import hashlib
import importlib.util
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vocspark.llm import (common, fingerprint, hnsw, jaccard, langid, licenses, linear, mixing, packing, quality,
                          quotes, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, copies int"
W = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def prose(r, n):
    return " ".join(r.choice(W) for _ in range(n)) + "."


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None, "x", 1, 2)


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [doc(i, ". ".join(prose(r, r.randrange(3, 30)) for _ in range(r.randrange(1, 9))), source="abc"[i % 3])
            for i in range(40)]
    base = prose(r, 200).split()
    for i in range(40, 52):
        own = list(base)
        own[r.randrange(200)] = "changed"
        rows.append(doc(i, " ".join(own), source="a"))
    rows += [doc(60, rows[0][1]), doc(61, rows[0][1]), doc(62, None, None, None), doc(63, ""), doc(64, "one"),
             doc(65, "one two"), doc(66, " \t\n"), doc(67, "ONE"), doc(68, "!!! 123 ..."),
             doc(69, prose(r, 20_000)), doc(70, "same row"), doc(70, "same row"), doc(None, "no id at all here")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard_against_brute_force(docs, none):
    for num, k in ((90, 3), (80, 5)):
        rows = docs.select("doc_id", "text").collect()
        sets = []
        for x in rows:
            w = (x.text or "").encode().lower().split()
            sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        at = {}
        for x, s in zip(rows, sets, strict=True):
            if x.doc_id is not None:
                at.setdefault(x.doc_id, []).append(s)
        label = {i: i for i in at}
        moved = True
        while moved:
            moved = False
            for i in at:
                for j in at:
                    if any(p and q and 100 * len(p & q) >= num * len(p | q) for p in at[i] for q in at[j]):
                        low = min(label[i], label[j])
                        moved |= label[i] != low or label[j] != low
                        label[i] = label[j] = low
        got = jaccard.jaccard_components(docs, num, 100, k).collect()
        assert len(got) == len(rows)
        assert sorted(x.n_shingles for x in got) == sorted(map(len, sets))
        assert all(x.component_id == label.get(x.doc_id) for x in got)
        assert max(label.values()) > min(i for i in label.values())
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.drop_near_duplicates(docs, 90, 100, 3)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.select("doc_id").collect()]
    assert ids.count(70) == 1 and 60 not in ids and {62, 63, 66, 40} <= set(ids) and ids.count(None) == 1


def test_part_keys_meet_whenever_a_link_is_possible():
    r = np.random.default_rng(2)
    for n in (9, 10, 17, 18, 27, 60, 100, 300, 900):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            drop = r.integers(0, n // 9 + 1)
            add = n // 9 - drop
            b = np.unique(np.concatenate([r.permutation(a)[drop:], r.integers(0, 1 << 63, add).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(a) == len(b) == both or len(
                    np.intersect1d(jaccard.part_keys(a, 90, 100), jaccard.part_keys(b, 90, 100)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 5), (7, 7), (200, 300), (200, 301)]
    got = {x.vertex: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[9] == got[5] == 5 and got[301] == 200 and 7 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(docs, none):
    rows = sorted(docs.select("doc_id", "text").collect(),
                  key=lambda x: (x.doc_id is not None, x.doc_id or 0))
    texts = [x.text or "" for x in rows]
    want = []
    for i, t in enumerate(texts):
        n, after = len(t) // 4, texts[(i + 1) % len(texts)]
        e = t[:len(t) - n] + after[:n]
        want.append((rows[i].doc_id, len(t), hashlib.sha256(e.encode()).hexdigest()))
    got = fingerprint.fingerprints(docs).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(((x.doc_id, x.n_chars, x.edited_sha256) for x in got), key=key) == sorted(want, key=key)
    assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
    by = {x.doc_id: x for x in got}
    assert by[60].fingerprint == by[61].fingerprint == by[0].fingerprint != by[1].fingerprint
    assert by[60].near_next == 1.0 and by[62].fingerprint == by[63].fingerprint
    assert fingerprint.fingerprints(none).count() == 0


def test_peeling_recovers_what_differs(docs):
    pieces = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("t")) \
        .select("doc_id", fingerprint.paragraph_digests(F.col("t")).alias("k")).collect()
    sets = {x.doc_id: set(x.k) for x in pieces}
    got = {x.doc_id: x for x in fingerprint.fingerprints(docs).collect()}
    for i in (*range(0, 39), *range(40, 51)):
        a, b = sets[i], sets[i + 1]
        assert got[i].differ_next == len(a ^ b)
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b))


def test_mixing(docs, none):
    got = mixing.mix(docs, block_words=4).collect()
    assert len(got) == docs.count()
    total = sum(x.size for x in got)
    by = {}
    for x in got:
        assert 0 <= x.taken <= 2 * x.size
        s = by.setdefault(x.source, [x.target, x.source_size, 0])
        s[2] += x.taken
    assert sum(t for t, _, _ in by.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for target, size, taken in by.values():
        assert target <= 2 * size + 1e-6 and abs(taken - target) <= 40
    again = sorted((x.doc_id or -1, x.size, x.taken) for x in mixing.mix(docs, block_words=4).collect())
    assert again == sorted((x.doc_id or -1, x.size, x.taken) for x in got)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 4


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    left, fixed = dict(zip(names, (5, 2, 1) * len(names), strict=False)), {}
    rest = 1.5 * sum(sizes.values())
    while True:
        w = sum(left.values())
        over = [s for s in left if rest * left[s] / w > 2 * sizes[s]] if w else []
        if not over:
            return fixed | {s: rest * left[s] / w for s in left}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
        rest = 1.5 * sum(sizes.values()) - sum(fixed.values())
        for s in over:
            del left[s]


def test_targets_against_plain_resharing(spark):
    r = random.Random(1)
    for _ in range(4):
        sizes = {s: r.choice((0, 3, 50, 1000, 9000)) + r.randrange(1, 9) for s in ["b", "a", "é", "Z", "c", "d", None]}
        plan = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = water_fill(sizes)
        assert {x.source: pytest.approx(x.target) for x in plan} == want


def test_packing(docs, none):
    path = importlib.util.find_spec("public_tokenizers")
    if path is None:
        pytest.skip("no tokenizer files here")
    import public_tokenizers
    from tokenizers import Tokenizer

    name = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(name)
    rows = docs.select("doc_id", "text").collect()
    ids = {x.doc_id: np.array(tok.encode(x.text or "", add_special_tokens=False).ids + [2], "<u4") for x in rows}
    got = packing.pack(docs, name, capacity=64, shard_chars=5000).toPandas()
    assert got["length"].sum() == sum(len(ids[x.doc_id]) for x in rows)
    for x in got.itertuples():
        piece = ids[None if x.doc_id != x.doc_id or str(x.doc_id) == "<NA>" else int(x.doc_id)][x.start:x.start + x.length]
        assert zlib.crc32(piece.tobytes()) == x.ids_crc32 and len(piece) == x.length
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].to_numpy() == np.r_[0, seq["length"].cumsum()[:-1]]).all() and seq["length"].sum() <= 64
    assert packing.pack(none, name).count() == 0
    tricky = ["J̌ A B", "<|endoftext|> <|ENDOFTEXT|>", "a.\tb, c.d 'S don't", "x" * 300, "é.\n\x1c y"]
    for a, b in zip(packing.encode(tricky, name), tok.encode_batch(tricky, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids


def test_new_words_are_encoded_many_at_a_time(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    name = public_tokenizers.path("word_bpe_49k.json")
    tok, *rest = packing._tokenizer(name)
    sent = []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return tok.encode_batch_fast(texts, **kw)

    r = random.Random(8)
    texts = [" ".join("".join(r.choices("abcdeFGéßÜ12.,'$", k=r.randrange(1, 14))) for _ in range(200)) for _ in range(20)]
    texts += ["İstanbul e\u0301 \u1100\u1161 ½ x\x85y a\xa0b <|endoftext|> " + texts[0], "字 ſ ŉ Ⱥ"]
    odd = {w for t in texts[20:] for w in t.split()}
    monkeypatch.setitem(common.worker_state(), ("tokenizer", name), (Counted(), {}, *rest[1:]))
    for a, b in zip(packing.encode(texts, name), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert a.tolist() == b.ids
    assert len(sent) < 30 + len(odd) < len(set(" ".join(texts[:20]).split())) // 10


def test_place_fills_all_sequences_but_one():
    r = random.Random(4)
    for n in (1, 2, 9, 80):
        lengths = sorted((r.randrange(1, 64) for _ in range(n)), reverse=True)
        used = {}
        for item, pieces in enumerate(packing.place(lengths, 64)):
            assert sum(p[1] for p in pieces) == lengths[item]
            for _, k, seq, _ in pieces:
                used[seq] = used.get(seq, 0) + k
        assert sorted(used.values())[1:] == [64] * (len(used) - 1)


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 200
    rows = [(5, "http://a/\r\nx", big), (3, "http://b", big), (4, None, "small"), (6, "u", "small"), (7, "u", None),
            (8, "u", ""), (9, "u", big), (9, "u", big), (None, "u", "x" * 150), (10, "u", "y" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("shard", F.lit("clash"))
    sums = []
    for run in range(2):
        folder = str(tmp_path / f"w{run}")
        m = warc.write_warc(pages.repartition(1 + 3 * run), folder, shard_bytes=2500, roll_bytes=400).collect()
        sums.append(sorted((x.file, x.sha256) for x in m))
        got = warc.read_warc(spark, folder).collect()
        assert len(got) == len(rows) and all(x.sound for x in got)
    assert sums[0] == sums[1] and len(sums[0]) > 3
    by = {x.page_id: x for x in got}
    assert by[3].record_type == "response" and by[5].refers_to == 3 and by[9].record_type == "revisit"
    assert by[4].record_type == by[6].record_type == by[7].record_type == by[None].record_type == "response"
    assert by[5].payload_digest == hashlib.sha256(big.encode()).hexdigest() and by[5].payload_bytes == len(big.encode())
    empty = str(tmp_path / "none")
    assert warc.write_warc(pages.limit(0), empty).count() == 0 and warc.read_warc(spark, empty).count() == 0


def test_warc_payloads_of_one_id(spark, tmp_path):
    a, b, c = "a" * 150, "b" * 150, "c" * 150
    rows = [(3, "u", a), (5, "u", a), (5, "u", b), (5, "u", c), (5, "v", c), (6, "u", c), (6, "u", b + "x"), (7, "u", "d" * 150),
            (None, "u", a), (None, "u", "n" * 150), (None, "u", "m" * 150), (None, "v", "m" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    warc.write_warc(pages, folder)
    got = warc.read_warc(spark, folder).collect()
    name = {hashlib.sha256(x.encode()).hexdigest(): x for _, _, x in rows}
    assert all(x.sound for x in got)
    assert sorted((x.page_id or 0, name[x.payload_digest], x.refers_to or 0) for x in got) == sorted([
        (3, a, 0), (5, a, 3), (5, b, 0), (5, c, 0), (5, c, 5), (6, c, 5), (6, b + "x", 0), (7, "d" * 150, 0),
        (0, a, 3), (0, "n" * 150, 0), (0, "m" * 150, 0), (0, "m" * 150, 0)])
    assert all((x.record_type == "revisit") == (x.refers_to is not None) for x in got)
    heads = [h for f in (tmp_path / "w").glob("part-*.warc.gz") for h, _ in warc.parse(f.read_bytes())]
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(rows)
    for h in heads:
        if h["warc-type"] == "revisit":  # what it refers to is a response with its payload
            to = ids[h["warc-refers-to"]]
            assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"]


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello  there\nsecond line"), (1, 1, "b", "On Monday, A wrote:\n> hello there\nmy answer"),
        (1, 2, "a", "> my ANSWER\n>> Hello there\nnot so"), (1, 3, "b", "unrelated"), (1, 4, "c", "> unknown words\nhm"),
        (2, 0, "a", None), (2, 1, "b", "> \n"), (None, 1, "b", "> x"), (3, 1, "a", "> not yet said"), (3, 2, "a", "not yet said"),
        (1, 5, "a", "> hm"), (1, 5, "a", "> hm")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(9))
    got = quotes.link_quotes(m).collect()
    assert len(got) == len(rows)
    by = {(x.conv_id, x.turn): x for x in got}
    assert by[1, 1].parent_turn == 0 and by[1, 1].clean_text == "my answer"
    assert (by[1, 2].parent_turn, by[1, 2].root_turn, by[1, 2].depth, by[1, 2].max_level, by[1, 2].n_linked) == (1, 0, 2, 2, 2)
    assert by[1, 4].parent_turn is None and by[1, 4].n_quoted == 1 and by[1, 5].parent_turn == 4
    assert by[3, 1].parent_turn is None and by[2, 0].clean_text == "" and by[None, 1].place == 0
    assert [by[1, t].place for t in (0, 1, 2)] == [0, 1, 2]
    assert sorted(x.place for x in got if x.conv_id == 1 and x.turn >= 4) == [0, 1, 2]
    assert quotes.link_quotes(m.limit(0)).count() == 0


def test_hnsw_against_brute_force(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[100:140] = x[5] + r.normal(size=(40, 16)) * 0.12
    x[150] = x[7]
    rows = [(i, [float(v) for v in np.float32(y)]) for i, y in enumerate(x)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [None] + [1.0] * 15), (404, [float("nan")] * 16),
             (405, [1.0, 2.0]), (406, [1.0, 2.0]), (7, rows[7][1]), (None, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash"))
    v = np.array([y for _, y in rows[:300]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    out, audits = hnsw.link_embeddings(df)
    got = {y.vec_id: y for y in out.collect()}
    assert out.count() == len(rows)
    assert [got[i].n_links for i in range(300)] == near.sum(1).tolist()
    assert got[150].component_id == 7 and got[405].n_links == got[406].n_links == 1 and got[None].kept
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(400, 405))
    assert audits.agg(F.min("recall")).first()[0] >= 0.9
    assert hnsw.link_embeddings(df.limit(0))[0].count() == 0


def test_quotes_wrapped_anew(spark):
    rows = [
        (1, 0, "a", "We should move the meeting to Friday, since the room\nis taken. Please tell the others about it\nsoon. Bye"),
        (1, 1, "b", "Fine with me."),
        (1, 2, "c", "> We should move the meeting to\n> Friday, since the room is\n> taken. Please tell the others\n"
                    "> about it soon. Bye\nI will."),
        (1, 3, "a", ">> We should move the\n>> meeting to Friday, since the room is taken.\n> I will.\nThanks")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {x.turn: x for x in quotes.link_quotes(m).collect()}
    assert (by[2].parent_turn, by[2].root_turn, by[2].n_quoted, by[2].n_linked) == (0, 0, 4, 4)
    assert (by[3].parent_turn, by[3].root_turn, by[3].depth, by[3].n_linked) == (2, 0, 2, 3)
    assert by[1].parent_turn is None


def test_quotes_of_lines_said_before(spark):
    rows = [(1, 0, "a", "Thanks\nfirst"), (1, 1, "b", "Thanks\nsecond"), (1, 2, "a", "> Thanks\n> second\nThanks"),
            (1, 3, "b", "> Thanks\nwelcome"), (1, 4, "c", "> Thanks\n> first\nme too")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {x.turn: x for x in quotes.link_quotes(m).collect()}
    assert [by[t].parent_turn for t in range(5)] == [None, None, 1, 2, 0]
    assert [by[t].n_linked for t in range(5)] == [0, 0, 2, 1, 2]


def brute_links(ids, x, threshold=0.95):
    v = x / np.linalg.norm(x, axis=1)[:, None]
    near = (v @ v.T >= threshold) & (ids[:, None] != ids[None, :])
    return {int(i): int(near[ids == i].sum()) for i in set(ids)}


def as_rows(ids, x):
    return pd.DataFrame({"vec_id": ids, "embedding": list(x)})


def links_of(out):
    return out[out["root"].isnull() & out["vec_id"].notnull()].groupby("vec_id")["n_links"].sum().to_dict()


def test_hnsw_copies_are_one_node():
    r = np.random.default_rng(4)
    x = r.normal(size=(5300, 16))
    x[:5000] = x[5299]
    x[5000:5020] = x[5299] + r.normal(size=(20, 16)) * 0.1
    x[5200] = x[5100] * 2
    ids = np.arange(5300)
    ids[5201] = 5100  # one id with two vectors,
    x[5201] = x[5100] * 3  # which would link
    ids[5202] = 7  # and one of the copies has another
    want = {i: n for i, n in brute_links(ids, x).items() if n}
    tracemalloc.start()
    out = hnsw._build(0.95)((16, 0), as_rows(ids, x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links_of(out) == want
    assert peak < 150 << 20  # 25 million pairs are 400 MB
    graph = out.dropna(subset=["graph"])
    asked = hnsw._query(0.95)((16, 0, 0), as_rows(ids[:5010] + 10_000, x[:5010]), graph)
    both = np.concatenate([ids[:5010] + 10_000, ids]), np.concatenate([x[:5010], x])
    v = both[1] / np.linalg.norm(both[1], axis=1)[:, None]
    assert links_of(asked) == {10_000 + i: int((v[i] @ v[5010:].T >= 0.95).sum()) for i in range(5010)}
    assert len(asked) < 3 * 5010


def torn(x, mult=None):
    """A graph of which beams find only the entry point."""
    g = hnsw.Graph(np.arange(len(x)), x, mult).build()
    for layer in g.layers:
        layer.nbr[:] = -1
    g.comp = np.arange(len(x))
    return g


def test_hnsw_audit_sees_lost_links(monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 24))
    x[700] = x[20] * 2  # rare links
    g = torn(x)
    recall, beam = g.audit(g.ids, x, g.ids, 0.95)
    assert beam > hnsw.WIDEST_BEAM and g.linked(x, g.ids, 0.95).sum() == 2
    # a crowd that is always found, and ordinary pairs that are not
    monkeypatch.setattr(hnsw, "AUDIT", 50)
    x = r.normal(size=(1500, 24))
    x[:500] = x[0] + r.normal(size=(500, 24)) * 0.05
    x[1000:1250] = x[750:1000] + r.normal(size=(250, 24)) * 0.05
    g = torn(x)
    recall, beam = g.audit(g.ids, x, g.ids, 0.95)
    assert recall >= 0.995 and beam > hnsw.WIDEST_BEAM
    # queries from other shards
    g = torn(x)
    got = hnsw._query(0.95)((24, 0, 0), as_rows(np.arange(5000, 5250), x[750:1000] * 1.5),
                            pd.DataFrame({"graph": [g.to_bytes()]}))
    assert links_of(got) == dict.fromkeys(range(5000, 5250), 2)
    # a sound graph passes, with what it finds
    g = hnsw.Graph(np.arange(1500), x).build()
    recall, beam = g.audit(g.ids, x, g.ids, 0.95)
    assert recall >= 0.995 and g.linked(x, g.ids, 0.95).sum() >= 0.99 * g.linked(x, g.ids, 0.95, hnsw.SCAN).sum()


def test_licenses(docs, none):
    def find(text):
        return licenses.scan(text, licenses.notices())

    x = find("The GNU General Public License, and MIT-license. mit license mit license")
    assert (x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == (4, 1, 10, "gpl,mit")
    x = find("some words Relased under the MIT Licence here")
    assert x["n_base"] == 0 and "mit" in x["labels"].split(",") and 0 < x["score"] < 1
    assert x["spans"][0]["first_word"] == 2 and x["spans"][0]["last_word"] == 6 and x["spans"][0]["edits"] > 0
    assert find(None)["n_words"] == 0 and find("mit élicense")["n_base"] == 0 and find("licensed bee")["labels"] == ""
    assert licenses.scan_licenses(docs).count() == docs.count() and licenses.scan_licenses(none).count() == 0


def test_licenses_next_to_each_other():
    gpl = licenses.Notice("gpl", "gnu general public license", 3)

    def spans(text):
        norm = licenses.words_of(text)
        return [(norm[a:b].decode(), e) for a, b, e in licenses.fuzzy(norm, gpl)]

    first, second = "gnu general publik licence", "gnu general public license"
    assert spans(f"x {first} {second} y") == [(first, 2), (second, 0)]
    assert spans(f"{second} {first}") == [(second, 0), (first, 2)]
    assert spans(f"a {second} b {first} or {second}") == [(second, 0), (first, 2), (second, 0)]
    assert [t for t, _ in spans(" ".join([first, second] * 40))] == [first, second] * 40
    both = licenses.scan(f"{first}, {second}", licenses.notices())
    assert [(s["first_word"], s["last_word"], s["edits"]) for s in both["spans"] if s["label"] == "gpl"] == [(0, 3, 2), (4, 7, 0)]


def test_short_licenses_with_errors():
    def find(text):
        x = licenses.scan(text, licenses.notices())
        return x["labels"], [(s["text"], s["edits"]) for s in x["spans"]]

    assert find("under MIT Licence here") == ("mit", [("mit licence", 1)])
    assert find("Apache Licence 2.0") == ("apache", [("apache licence", 1)])
    assert find("see Apache Lisence, MIT License") == ("apache,mit", [("apache lisence", 2), ("mit license", 0)])
    assert find("CCBY 4.0") == ("cc-by", [("ccby", 1)])
    assert find("mit licence mit lisense")[1] == [("mit licence", 1), ("mit lisense", 1)]
    for text in ("mit linse", "mit silence", "mit diesen", "apache science", "summit license", "permit licence", "cc bye",
                 "acc by", "cc", "mit", "apache"):
        assert find(text) == ("", []), text


def test_quality(spark, docs, none):
    r = random.Random(8)
    rows = [doc(i, prose(r, 30) if i % 4 else " ".join(w + "###" for w in prose(r, 30).split())) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(9999, 1), (1, None), (None, 1)],
                                   "doc_id long, label int")
    model = quality.fit(df, labels)
    got = {x.doc_id: x.score for x in quality.score_quality(df, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 > 0) for i in range(400))
    out = quality.score_quality(docs, model)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(none, model).count() == 0
    assert quality.fit(none, labels) is None and quality.fit(df, labels.limit(0)) is None
    assert quality.score_quality(docs, None).where("score != 0.5").count() == 0


def test_language(spark, docs, none):
    r = random.Random(9)
    make = {"en": "the and ing", "de": "der und sch", "fr": "les des oui", "es": "los que año"}
    rows = [doc(i, " ".join(r.choice(make[x].split()) + r.choice(W) for _ in range(20)), x)
            for i, x in enumerate(list(make) * 60)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df.where("doc_id % 2 = 0 or doc_id % 4 in (1, 3)").where("doc_id < 160"))
    got = langid.identify(df, model).where("doc_id >= 160 and lang != lang_pred").count()
    assert got == 0
    out = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (62, 63, 66, 68))
    assert langid.identify(none, model).count() == 0 and langid.fit(none) is None
    assert langid.identify(docs, None).where("lang_pred != 'und'").count() == 0


def test_dual_descent_separates():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5))
    y = np.where(x[:, 0] + 0.2 * x[:, 1] > 0, 1.0, -1.0)
    w = linear.dual_descent([(np.arange(5), v) for v in x], y, 5, c=10.0, epochs=60)
    assert (np.sign(x @ w[:5] + w[5]) == y).mean() > 0.97
