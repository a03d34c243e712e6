"""Vector searches, piece encoding, WARC archives, registered queries and the pipeline."""

import gzip
import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import sentencepiece

from datamill.llm import inner_product, pieces, projected_nn, toxicity, vectors as vectors_module, warc
from datamill.llm.queries import QUERIES, SQL, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=16).tolist(), 0) for i in range(3000)]
    data += [(5000 + i, (rng.normal(size=16) * 0.01 + 1).tolist(), 1) for i in range(300)]
    data += [(6000, None, 0), (6100, [0.0] * 16, 0), (6200, [float("nan")] + [1.0] * 15, 0), (6300, [None] + [1.0] * 15, 0), (6400, [float("inf")] + [1.0] * 15, 0), (6500, [1.0, 2.0], 0), (None, [1.0] * 16, 0), (200, data[7][1], 0)]
    return spark.createDataFrame(data, "vec_id long, embedding array<double>, p int")


def plain(vectors, zero):
    out = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == 16]
    out = [(i, v) for i, v in out if all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    return np.array([i for i, _ in out]), np.array([v for _, v in out])


def test_nearest_recall(vectors):
    got = projected_nn.nearest(vectors).toPandas()
    ids, v = plain(vectors, False)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        candidates = [np.sqrt(((v - own) ** 2).sum(1)) for own in v[ids == q]]
        best = min((set(ids[ids != q][np.lexsort((ids[ids != q], d[ids != q]))[:10]]) for d in candidates), key=lambda s: len(set(part["vec_id"]) ^ s))
        hits, total = hits + len(best & set(part["vec_id"])), total + 10
        assert part["score"].is_monotonic_increasing
    assert hits / total >= 0.95 and {6000, 6100, 6200, 6300, 6400, 6500}.isdisjoint(got["query_id"])


def test_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(200_000, 8)) ** 2).sum(1)
    for p in (0.5, 0.9, 0.98):
        assert (x <= projected_nn.chi_square_quantile(p, 8)).mean() == pytest.approx(p, abs=0.005)


def test_products_are_exact(vectors, spark):
    rows = vectors.where("vec_id IS NULL OR vec_id <> 200")
    rng = np.random.default_rng(2)
    more = spark.createDataFrame([(7000 + i, (rng.normal(size=16) * 10 ** rng.uniform(-2, 2)).tolist(), 0) for i in range(400)], rows.schema)
    rows = rows.unionByName(more)
    got = inner_product.largest_products(rows).toPandas()
    ids, v = plain(rows, True)
    w = np.floor(256 * v).astype(np.int64)
    for q in ids[ids % 50 == 0]:
        scores = w @ w[ids == q][0]
        other = ids != q
        order = np.lexsort((ids[other], -scores[other]))[:5]
        part = got[got["query_id"] == q].sort_values("rank")
        assert part["vec_id"].tolist() == ids[other][order].tolist() and part["score"].tolist() == scores[other][order].tolist()


def test_coordinate_pruning_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = rng.normal(size=(50, 6))
        lengths = np.sqrt((v**2).sum(1))
        q = rng.normal(size=6)
        norm, bound = np.sqrt((q**2).sum()), rng.uniform(0, 8)
        kept = set(*inner_product.Block(v, lengths).candidates(q[None], np.array([norm]), np.array([bound])))
        assert set(np.nonzero(v @ q >= bound)[0]) <= kept


def test_blocks_of_close_directions_are_left_out(spark):
    """Tight clusters: a query visits the blocks of its own cluster, and still nothing is lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 32))
    v = np.concatenate([c + 0.05 * rng.normal(size=(600, 32)) for c in centres])
    whole = np.floor(256 * v)
    lengths = np.sqrt((whole**2).sum(1))
    balls = pd.concat([inner_product.ball(pd.DataFrame({"v": list(whole[i:i + 600]), "cell": i, "chunk": 0, "length": lengths[i:i + 600]})) for i in range(0, 9600, 600)])
    asked = pd.DataFrame({"id": range(0, 9600, 50), "v": list(whole[::50]), "length": lengths[::50]})
    first = inner_product._first(balls, asked)
    assert first["id"].tolist() == asked["id"].tolist()
    todo = asked.assign(cell=first["cell"].to_numpy(), chunk=0, bound=[np.sort(whole @ q)[-6] for q in whole[::50]])
    assert len(inner_product._others(balls, todo)) < 0.2 * 16 * len(asked)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in inner_product.largest_products(table).collect()}
    for q in range(0, 9600, 50):
        scores = (whole @ whole[q]).astype(int)
        scores[q] = -2**62
        order = np.lexsort((np.arange(9600), -scores))[:5]
        assert [got[q, rank] for rank in range(1, 6)] == [(i, scores[i]) for i in order]


def test_samples_are_bounded_and_repeat(spark):
    rows = spark.range(20_000).selectExpr("id", "array(double(id)) AS v").unionByName(spark.range(9_000).selectExpr("1L AS id", "array(1.0D) AS v"))
    first, again = (vectors_module.sample_of(rows.repartition(n), 29_000, 1000)["id"].tolist() for n in (3, 11))
    assert first == again and 700 <= len(first) <= 1000 and len(set(first)) == len(first)
    assert len(vectors_module.sample_of(rows.limit(0), 0, 1000)) == 0


def test_blocks_without_a_visit_stay(spark):
    """A block travels once for each part of its visitors; one that nobody visits does not travel."""
    blocks = spark.createDataFrame([(i, i % 4, 0) for i in range(40)], "id long, cell long, chunk int")
    asked = spark.createDataFrame([(7,), (8,)], "id long")
    visits = spark.createDataFrame([(7, 1, 0, 0.0), (8, 1, 0, 0.0), (8, 3, 0, 0.0)], "id long, cell long, chunk int, bound double")
    got = vectors_module.search(blocks, asked, visits, lambda block, part: [(q, block["id"].to_numpy(), block["id"].to_numpy() * 1.0) for q in part["id"]], "double")
    pairs = sorted((r["query_id"], r["vec_id"]) for r in got.collect())
    assert pairs == [(7, i) for i in range(1, 40, 4)] + sorted((8, i) for i in range(40) if i % 4 in (1, 3))


def test_few_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (100, [0.0, 1e300])], "vec_id long, embedding array<double>")
    assert projected_nn.nearest(rows).count() == 4 and inner_product.largest_products(rows).count() == 4
    empty = rows.limit(0)
    assert projected_nn.nearest(empty).count() == 0 and inner_product.largest_products(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_repeated_ids_and_clashing_columns(spark, parts):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(400, 8)), 3)
    ids = [i % 300 for i in range(400)]
    data = [(i, x.tolist(), *[0] * 8) for i, x in zip(ids, v)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, id int, v int, p int, cell int, chunk int, part int, bound int, length int").repartition(parts)
    for asked, found, score in ((0, projected_nn.nearest(table), lambda a, b: float(np.sqrt(((a - b) ** 2).sum()))),
                                (50, inner_product.largest_products(table), lambda a, b: int((np.floor(256 * a) * np.floor(256 * b)).sum()))):
        # Of a repeated id the smallest vector asks.
        first = np.array(min(x.tolist() for i, x in zip(ids, v) if i == asked))
        assert sum(i == asked for i in ids) == 2
        scores = sorted(((score(first, x), i) for i, x in zip(ids, v) if i != asked), key=lambda r: (r[0] if score(first, first) == 0.0 else -r[0], r[1]))
        got = [(r["vec_id"], r["score"]) for r in found.where(f"query_id = {asked}").orderBy("rank").collect()]
        assert [i for i, _ in got] == [i for _, i in scores[:len(got)]] and len(got) in (5, 10)
        assert [x for _, x in got] == pytest.approx([x for x, _ in scores[:len(got)]])


# --- pieces --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(7)
    alphabet = [*"abc  \n\t▁.é́\0ß日\U0001F600ﬁ", "<s>", "<0x0A>", "the", "ing", " of", "\r\n", "    "]
    return ["", " ", "\n", "▁", "x" * 3000, "日" * 200, " " * 50 + "a", *["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)]]


def test_pieces_like_the_library(spark, library):
    data = [(i, t) for i, t in enumerate(texts())] + [(None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in pieces.token_digests(docs, MODEL).collect()}
    spans = {r["doc_id"]: r for r in pieces.encode(docs, MODEL).collect()}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()}
    for i, t in data:
        ids = library.encode(t or "")
        text = library.decode(ids)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert spans[i]["ids"] == ids and back[i] == text
        raw = (t or "").encode()
        covered = b"".join(raw[b:e] for b, e in dict.fromkeys(zip(spans[i]["begins"], spans[i]["ends"])) if b != e)
        assert len(set(zip(spans[i]["begins"], spans[i]["ends"]))) == 0 or spans[i]["ends"][-1] == len(raw)
        assert covered == raw
    assert pieces.token_digests(docs.limit(0), MODEL).count() == 0


def test_digests_come_from_the_encoded_pieces(spark, monkeypatch):
    """The query and the stage digest what ``encode`` returns, and the spans are those of a plain projection."""
    data = [(i, t) for i, t in enumerate(texts()[:300])] + [(None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pieces.piece_digests(pieces.encode(docs, MODEL), MODEL).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in data:
        spans, at, left, text = [], 0, 0, t or ""
        for n in library.encode(text):
            if left:
                left -= 1
            else:
                size = 1 if library.is_byte(n) else len(library.id_to_piece(n))
                begin, at = at, at + size
                left = len(text[begin - 1].encode()) - 1 if library.is_byte(n) else 0
            # The library puts one space mark in front, which no byte of the text stands for.
            spans += [len(text[:max(0, x - 1)].encode()) for x in (begin, at)]
        assert rows[i]["spans_sha256"] == hashlib.sha256(np.array(spans, "<i4").tobytes()).hexdigest()
    called, encode = [], pieces.encode
    monkeypatch.setattr(pieces, "encode", lambda *a, **k: called.append(1) or encode(*a, **k))
    assert {r["doc_id"]: tuple(r)[1:] for r in pieces.token_digests(docs, MODEL).collect()} == {i: tuple(r)[1:4] for i, r in rows.items()} and called


def test_memory_is_bounded_and_keeps_common_segments(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    with open(MODEL, "rb") as f:
        encoder = pieces.Encoder(f.read())
    merged, merger = [], encoder.merger

    class Counting:
        def encode(self, some, **options):
            merged.extend(some)
            return merger.encode(some, **options)

    encoder.merger = Counting()
    for i in range(60):
        got = encoder.remember(["▁the", f"▁word{i}"])
        assert got == [encoder.memory["▁the"], encoder.memory[f"▁word{i}"]]
        assert len(encoder.memory) + len(encoder.older) <= 20
    assert merged.count("▁the") == 1 and len(merged) == 61


def test_compiled_map_like_the_library():
    normaliser = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = {3: 1, 4: 1, 5: 1} | dict(pieces._fields(dict(pieces._fields(normaliser.serialized_model_proto()))[3]))
    encoder = object.__new__(pieces.Encoder)
    encoder.map = pieces.CharacterMap(spec[2])
    encoder.dummy_prefix, encoder.trim, encoder.escape = (bool(spec[i]) for i in (3, 4, 5))
    for text in ["ﬁne ①②  Ｆｕｌｌ", "é Å ㍿ …", "tab\tand space", "한글 ｶﾞ", "plain"]:
        normal, origin = encoder.normalise(text)
        assert normal == normaliser.normalize(text)
        assert len(origin) == len(normal) + 1 and origin == sorted(origin) and origin[-1] == len(text.encode())


# --- WARC ----------------------------------------------------------------------------------------


def pages(spark):
    big = "<p>é" + "x" * 2000
    data = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "b\r\nc", big), (4, None, "small"), (6, "u", "small"), (7, "u", None), (7, "u", ""), (None, "n", big), (8, "w", "WARC/1.1\r\nnot a record" + "y" * 3000)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def test_round_trip(spark):
    got = warc.archive_and_read(pages(spark), archive_bytes=500)
    rows = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got.collect()}
    assert rows == {(1, "revisit", 5, 2005), (5, "response", None, 2005), (3, "revisit", 5, 2005), (4, "response", None, 5), (6, "response", None, 5), (7, "response", None, 0), (None, "revisit", 5, 2005), (8, "response", None, 3022)}
    assert got.count() == 9 and got.where("kind = 'gap'").count() == 0
    assert {r["payload_digest"] for r in got.where("page_id = 5").collect()} == {hashlib.sha1(("<p>é" + "x" * 2000).encode()).hexdigest()}
    assert warc.archive_and_read(pages(spark).limit(0)).count() == 0


def records(n, packed):
    made = []
    for i in range(n):
        body = f"page {i} ".encode() * 50
        data = warc.record_bytes(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None, False)
        made.append(warc.member(data) if packed else data)
    return made


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    made = records(12, packed)
    starts = np.cumsum([0, *map(len, made)])
    damaged = bytearray(b"".join(made))
    for i in (0, 4, 5):
        damaged[starts[i] + len(made[i]) // 2] ^= 0xFF
    data = bytes(damaged) + made[0][: len(made[0]) // 2]
    found = list(warc.salvage(data))
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [1, 2, 3, 6, 7, 8, 9, 10, 11]
    gaps = [(r["begin"], r["end"]) for r in found if r["kind"] == "gap"]
    assert gaps == [(0, starts[1]), (starts[4], starts[6]), (starts[12], len(data))]
    assert sorted((r["begin"], r["end"]) for r in found)[0][0] == 0 and all(r["reason"] for r in found if r["kind"] == "gap")
    assert list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"garbage")] == ["gap"]
    if packed:
        assert gzip.decompress(made[0]).startswith(b"WARC/1.1\r\n")


def kinds(data):
    found = list(warc.salvage(data))
    return [r["page_id"] for r in found if r["kind"] == "record"], [(r["begin"], r["end"], r["reason"]) for r in found if r["kind"] == "gap"]


def test_salvage_inside_a_member():
    made = records(5, False)
    wrong = [*made[:1], made[1].replace(b"page 1 ", b"page X ", 1), *made[2:]]
    at = (len(made[0]), len(made[0]) + len(made[1]))
    # One record of a sound member is wrong.
    data = warc.member(b"".join(wrong)) + warc.member(records(9, False)[8])
    pages, gaps = kinds(data)
    assert pages == [0, 2, 3, 4, 8] and len(gaps) == 1 and f"bytes {at[0]} to {at[1]} of the member" in gaps[0][2]
    # None is right: the member is passed over as a whole.
    assert kinds(warc.member(wrong[1]) + warc.member(made[2])) == ([2], [(0, len(warc.member(wrong[1])), "digest and block disagree")])
    # The member is cut: the records before the cut stay.
    rng = random.Random(2)
    bodies = [rng.randbytes(50_000) for _ in range(5)]
    big = warc.member(b"".join(warc.record_bytes(i, "u", b, hashlib.sha1(b).hexdigest(), None, False) for i, b in enumerate(bodies)))
    pages, gaps = kinds(big[: len(big) * 3 // 4])
    assert pages == [0, 1, 2] and gaps[-1][2] == "member without end"
    # A byte of it is wrong: what its digest vouches for stays, and so does the next member.
    damaged = bytearray(big)
    damaged[len(big) * 3 // 10] ^= 0xFF
    pages, gaps = kinds(bytes(damaged) + made[0] + warc.member(made[3]))
    assert pages[0] == 0 and 1 not in pages and pages[-2:] == [0, 3] and any("damaged member" in g[2] for g in gaps)


def test_checksum_without_a_wrong_record():
    made = records(3, False)
    data = bytearray(warc.member(b"".join(made)))
    data[-6] ^= 0xFF
    pages, gaps = kinds(bytes(data) + warc.member(made[0]))
    assert pages == [0] and [(g[0], g[1]) for g in gaps] == [(0, len(data))]
    # Of a damaged member with a wrong record, records without a digest of their own are not trusted.
    revisit = warc.record_bytes(7, "u", b"x", "00" * 20, 1, True)
    data = bytearray(warc.member(made[0] + revisit + made[1].replace(b"page 1 ", b"page X ", 1)))
    data[-6] ^= 0xFF
    pages, gaps = kinds(bytes(data))
    assert pages == [0] and any("no digest" in g[2] for g in gaps)
    assert kinds(warc.member(made[0] + revisit)) == ([0, 7], []) and kinds(warc.member(b"")) == ([], [])


@pytest.mark.parametrize("packed", [True, False])
def test_no_record_out_of_a_block(packed):
    inner = records(100, False)[99]
    body = b"head " + inner + b" tail"
    outer = warc.record_bytes(1, "u", body, "00" * 20, None, False)
    last = records(3, False)[2]
    data = warc.member(outer) + warc.member(last) if packed else outer + last
    pages, gaps = kinds(data)
    assert pages == [2] and [g[2] for g in gaps] == ["digest and block disagree"]


def test_long_payloads_and_clashing_columns(spark):
    data = [(1, "u", "x" * 3_000_000, "d", 1), (2, "u", "x" * 3_000_000, None, 2), (2, None, None, "a", None), (None, "u", "short", "k", 3)]
    table = spark.createDataFrame(data, "page_id long, url string, html string, digest string, revisit int").selectExpr("*", "html AS kind", "url AS archive")
    got = warc.archive_and_read(table, archive_bytes=1000).where("kind = 'record'").select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (2, 0, "response", None), (None, 5, "response", None)], key=repr)


# --- queries -------------------------------------------------------------------------------------


def test_ten_operators_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_like_sql(spark, name):
    from test_queries import TABLES, table_rows

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = table_rows(QUERIES[name](spark, FOLDER).toPandas())
    result = con.execute(SQL[name])
    assert got == table_rows(pd.DataFrame(result.fetchall(), columns=[d[0] for d in result.description])) and got[1]


def test_pipeline_against_brute_force(spark):
    """Every stage is recomputed from its own input: which rows stay, and their texts."""
    import corpus_pipeline as c
    from test_text_operators import brute_classes

    raw = docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("toxic = 1").collect()}
    results = []
    for _, stage in c.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        results.append(docs.toPandas())
    clean, lines, near, mixed, encoded = results
    assert list(clean.columns) == list(lines.columns) == list(near.columns) == list(mixed.columns) == c.COLUMNS
    model = toxicity.train(raw, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    matcher = model.matcher()
    assert set(clean.doc_id) == {r["doc_id"] for r in raw.collect() if toxicity.probability(r["text"], model, matcher) < 0.5}
    assert len(toxic & set(clean.doc_id)) < len(toxic) / 2  # eleven examples teach the commonest terms only
    assert set(lines.doc_id) == set(clean.doc_id) and (lines.n_chars == lines.text.str.len()).all()
    assert sorted(near.doc_id) == [ids[0] for ids in brute_classes(list(zip(lines.doc_id, lines.text)))]
    assert set(mixed.doc_id) <= set(near.doc_id) and mixed.groupby("doc_id").size().max() <= 2
    assert sorted(encoded.doc_id) == sorted(mixed.doc_id)
