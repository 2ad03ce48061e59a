"""Archives, token counts, toxicity and language model: round trips, libraries and held-out results."""

import base64
import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException

from tests.conftest import SMALL
from tidemark.llm import lm, tokens, toxicity, warc
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def told(rows):
    """What the contract asks of (page_id, html)."""
    top = {}
    for i, h in rows:
        top[h or ""] = max((i, top.get(h or "")), key=lambda x: (x is not None, x or 0)) if (h or "") in top else i
    return Counter((i, len((h or "").encode()), b32((h or "").encode()), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]) for i, h in rows)


def test_op4_reads_back_what_it_wrote(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op4_warc_dictionary"](spark, SMALL).collect())) == told(rows)


def test_op4_equal_empty_null_and_repeated(spark):
    rows = [(1, "same"), (2, "same"), (9, "same"), (3, None), (4, ""), (5, "é" * 50_000), (6, "x\r\n\r\nWARC/1.1\r\n"), (7, "solo"), (7, "solo"), (None, "solo"), (None, "none"), (9, "same")] + [(100 + i, f"<p>page {i}</p>" * 20) for i in range(60)]
    df = spark.createDataFrame([(i, None if i == 7 else f"http://a/{i}\n", h, "x", "y") for i, h in rows], "page_id long, url string, html string, sha1 string, first string")
    folder = warc.new_folder(spark)
    manifest = warc.write_archives(df.coalesce(1), folder)
    got = warc.read_archives(manifest)
    assert Counter(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == told(rows)
    assert {r.url for r in got.where("page_id = 7").collect()} == {None} and {r.url for r in got.where("page_id = 1").collect()} == {"http://a/1"}
    empty = warc.write_archives(df.limit(0), warc.new_folder(spark))
    assert empty.count() == 0 == warc.read_archives(empty).count()


def test_op4_archive_layout():
    """A skippable frame with a dictionary leads; every record is a frame that it alone decompresses."""
    records = [warc.record(i, f"http://x/{i}", (f"<html>{i} " + "common words of every page " * 30).encode(), [3] if i % 5 == 0 else None) for i in range(200)]
    data = warc.pack(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and data[8:12] == b"\x37\xa4\x30\xec"
    z, at, frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])), 8 + size, []
    while at < len(data):
        one = z.decompressobj()
        frames.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    assert frames == records
    back = list(warc.unpack(io.BytesIO(data)))
    assert len(back) == 200 and back[5][0]["WARC-Type"] == "revisit" and back[5][0]["WARC-Refers-To"] == "<urn:page:3>"


def test_op4_notices_a_cut_archive(spark):
    df = spark.range(80).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 400) as html")
    manifest = warc.write_archives(df.coalesce(1), warc.new_folder(spark))
    path = manifest.first().archive.removeprefix("file:")
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-30])
    with pytest.raises(PythonException):
        warc.read_archives(manifest).collect()


def test_op6_equals_the_library(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = tokens.vocabulary()
    pieces = [("<unk>", -30.0), *v.items(), *((f"<0x{i:02X}>", -30.0) for i in range(256))]
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in QUERIES["op6_token_counts"](spark, SMALL).collect():
        assert r.n_tokens == len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)


def slow_count(word, scores):
    unknown, best = min(scores.values()) - 10, [(0.0, 0)] + [None] * len(word)
    for e in range(1, len(word) + 1):
        ways = [(best[b][0] + scores[word[b:e]], -best[b][1] - 1) for b in range(e) if word[b:e] in scores]
        if word[e - 1] not in scores:
            ways.append((best[e - 1][0] + unknown, -best[e - 1][1] - len(word[e - 1].encode())))
        top = max(ways)
        best[e] = (top[0], -top[1])
    return best[-1][1]


def test_op6_trie_and_odd_texts(docs):
    scores = {"▁": -2.0, "a": -1.5, "b": -1.5, "ab": -2.5, "▁a": -2.2, "aba": -3.0, "▁ab": -3.9}
    odd = [None, "", " ", "a  b", "ab▁ab", "aé😀b", "a" * 500, "abab" * 3000, "x\ny"]
    got = tokens.token_counts(docs(*enumerate(odd), (0, None), extra=True), scores).collect()
    want = Counter((i, sum(slow_count(w, scores) for w in tokens.pretokens(t or ""))) for i, t in [*enumerate(odd), (0, None)] if len(t or "") < 1000)
    assert Counter((r.doc_id, r.n_tokens) for r in got if r.doc_id != 7) == want
    small, large = tokens.Trie(scores, most=3), tokens.Trie(scores)
    words = ["▁abab", "▁ab", "▁ba", "▁abab", "▁é", "▁aaaaab"] * 3
    assert [small.count(w) for w in words] == [large.count(w) for w in words] == [slow_count(w, scores) for w in words]
    assert tokens.token_counts(docs((1, "a")).limit(0), scores).count() == 0


def test_op5_on_held_out_labels(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op5_toxicity_neighbours"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) > 0.93
    assert sum(r.predicted and y[r.doc_id] for r in held) >= 0.9 * sum(r.predicted for r in held)


def test_op5_index_is_exact():
    rng = np.random.default_rng(4)
    n_terms, idf = 40, 1 + rng.random(40) * 3
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(n_terms, rng.integers(1, 6), replace=False))
        vectors.append(toxicity.unit(t, rng.integers(1, 5, len(t)), idf))
    dense = np.zeros((len(vectors), n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, n_terms, block=16)
    for q in range(0, 700, 7):
        cos = np.round(dense @ dense[q], 12)
        want = sorted((-c, i) for i, c in enumerate(cos) if c > 0)[:10]
        got = index.nearest(*vectors[q], 10)
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [-c for c, _ in want])
    assert index.scored < 100 * index.blocks


def test_op5_odd_inputs(spark, docs):
    rows = [(i, f"you fool number {i} really" if i % 3 == 0 else f"a nice day number {i} really") for i in range(60)] + [(100, None), (101, ""), (102, "fool " * 20000), (5, "a nice day number 5 really"), (None, "fool")]
    d = docs(*rows, extra=True)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(0, 1), (61, 1), (100, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(d, d.where("doc_id < 60"), labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[102].score > 0.8 and by[0].score > 0.8 and by[100].score < 0.5 and by[101].score == by[100].score and by[None].score > 0.5
    assert by[0].neighbours[0].cosine == pytest.approx(1) and "fool" in by[0].terms
    assert {r.score for r in toxicity.score(d, d, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(d.limit(0), d.where("doc_id < 60"), labels).count() == 0


def test_op5_small_tables_have_vectors(spark):
    """Rare words count too: with 87 labels no word has a document count and a chi-square to be chosen by."""
    got = QUERIES["op5_toxicity_neighbours"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert len({r.score for r in got}) > len(got) / 2 and all(r.terms for r in got if len(toxicity.TERM.findall(texts[r.doc_id] or "")) > 100)
    assert all(r.score > 0.3 for r in got if y.get(r.doc_id) and not r.held_out)


def test_op5_votes_stay_with_their_text(spark, docs):
    """Both texts of doc_id 1 are examples; one is also the text of doc_id 50, whose label gives it a further vote."""
    rows = [(1, "you fool"), (1, "nice day"), (50, "nice day"), (2, "fool"), (3, "nice")]
    labels = spark.createDataFrame([(1, 1), (50, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = {r.terms[0]: r.neighbours[0] for r in toxicity.score(docs(*rows), docs(*rows), labels).where("size(terms) = 2").collect()}
    assert {t: (n.yes, n.no) for t, n in got.items()} == {"fool": (1, 0), "day": (1, 1)}


def test_op5_doc_ids_do_not_decide_ties(spark, docs):
    """Two examples of unlike labels are equally near to "aaa"; exchanging their ids changes no score."""
    texts, toxic = ["aaa " * 20 + "bbb", "aaa " * 20 + "ccc", "aaa ggg", "eee", "fff", "hhh", "aaa"], [1, 0, 1, 1, 0, 0, None]
    scores = []
    for ids in ([1, 2, 3, 4, 5, 6, 7], [2, 1, 3, 4, 5, 6, 7]):
        d = docs(*zip(ids, texts, strict=True))
        labels = spark.createDataFrame(list(zip(ids, toxic, strict=True)), "doc_id long, toxic int")
        scores.append({texts[ids.index(r.doc_id)]: r.score for r in toxicity.score(d, d, labels, neighbours=1).collect()})
    assert scores[0] == scores[1]


def test_op5_index_with_common_terms_and_many_queries():
    """Terms of most examples go by the table, the others by postings; queries that share a product get what each gets alone."""
    rng = np.random.default_rng(6)
    n_terms, vectors = 300, []
    for _ in range(500):
        t = np.unique(np.concatenate([np.flatnonzero(rng.random(20) < 0.5), rng.choice(n_terms, 9)]))
        vectors.append(toxicity.unit(t, rng.integers(1, 5, len(t)), 1 + np.arange(n_terms) / 100))
    dense = np.zeros((len(vectors), n_terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    index = toxicity.BlockMaxIndex(vectors, n_terms, block=16)
    assert 10 < len(index.table) < 40
    for q, got in enumerate(index.nearest_of(vectors[:150], 7)):
        want = sorted((-c, i) for i, c in enumerate(np.round(dense @ dense[q], 12)) if c > 0)[:7]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [-c for c, _ in want])


LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_list(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), None]


def check_base(rows, got, learns):
    c = Counter()
    for i, t in rows:
        if learns(i):
            c.update(token_list(t))
    total = sum(c.values())
    want = sorted((str(i), len(w := token_list(t)), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w), 5)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want and {r.train_tokens for r in got} == {total}


def test_op7_base_and_held_out_gain(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op7_recurrent_lm"](spark, SF).collect()
    check_base(rows, got, lambda i: zlib.crc32(str(i).encode()) % 7 != 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_op7_odd_texts(docs):
    rows = [(1, "A a B É é"), (2, None), (3, ""), (1, "A a B É é"), (None, "zz top"), (4, "a " * 9000), (5, "never seen words")]
    d = docs(*rows, extra=True)
    got = lm.score(d, d.where("doc_id is null or doc_id < 5")).collect()
    check_base(rows, got, lambda i: i != 5)
    assert lm.score(d.limit(0), d).count() == 0 and all(r.n_known == 0 for r in lm.score(d, d.limit(0)).collect())


def test_op7_every_learning_document_moves_the_network(docs):
    rows = [(i, f"the cat number {i} sat on the mat") for i in range(5)] + [(None, "the cat sat")]
    v = lm.vocabulary(lm.token_counts(docs(*rows)))
    for row in rows:
        assert not np.array_equal(lm.fit(docs(row), v)["cb"], v.class_bias), row


def test_op7_lanes_go_on_with_the_next_document():
    """Forty documents of ten tokens and a long one keep eight lanes busy until the long one alone is left."""
    texts = [np.full(10, i, np.int32) for i in range(40)] + [np.full(60, 40, np.int32)]
    (own, ids, length), *more = lm._lanes(texts, 8)
    assert not more and len(ids) == 60 and length.sum() == 460 and all((own[:n, i] == ids[:n, i]).all() for i, n in enumerate(length))
    v, p = small_model()
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, v.n_head + lm.TAIL_CLASSES + 1, k) for k in rng.integers(1, 90, lm.SIDE * 3)]
    assert np.allclose(lm.log_likelihood(p, v, texts), [lm.log_likelihood(p, v, [t])[0] for t in texts])


def test_op7_words_that_are_not_broadcast(docs, monkeypatch):
    """With few words sent, the counts of the others come from the join."""
    rows = [(i, f"the cat {'sat ' * (i % 4)}on mat {i} the end") for i in range(30)] + [(30, "dog the never")]
    d = docs(*rows)
    monkeypatch.setattr(lm, "HEAD", 8)
    want = {r.doc_id: r for r in lm.score(d, d.where("doc_id < 30")).collect()}
    monkeypatch.setattr(lm, "KNOWN", 8)
    v = lm.vocabulary(lm.token_counts(d.where("doc_id < 30")))
    got = lm.score(d, d.where("doc_id < 30")).collect()
    check_base(rows, got, lambda i: i < 30)
    assert len(v.number) == 7 and all(math.isclose(r.score, want[r.doc_id].score) for r in got)


def small_model():
    words = [(f"w{i}".encode(), 400 // (i + 1)) for i in range(60)] + [(f"rare{i}".encode(), 1) for i in range(50)] + [(lm.END, 30)]
    total = sum(c for _, c in words) * 3
    mass = Counter()
    for w, c in words:
        if w and c * lm.HEAD < total:
            mass[lm.tail_class(w)] += c + 1
    v = lm.Vocabulary(words, total, len(words), mass)
    rng = np.random.default_rng(1)
    return v, {k: x.astype(float) + rng.standard_normal(x.shape) * 0.2 for k, x in lm.initial(v).items()}


def test_op7_probabilities_of_the_next_word_add_up():
    v, p = small_model()
    n = v.n_head + lm.TAIL_CLASSES + 1
    state = np.random.default_rng(2).standard_normal((1, lm.HIDDEN))
    logs, _, _ = lm.output(p, v, np.repeat(state, n, axis=0), np.arange(n))
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_op7_state_is_carried_and_gradients_are_right():
    v, p = small_model()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, v.n_head, k) for k in (3, 70, 33, 1)]
    whole, cut = lm.log_likelihood(p, v, docs, steps=200), lm.log_likelihood(p, v, docs, steps=7)
    assert np.allclose(whole, cut) and np.allclose([lm.log_likelihood(p, v, [d])[0] for d in docs], whole)
    _, ids, length = next(lm._lanes([d[:12] for d in docs], 8))
    live = [int((length > t).sum()) for t in range(len(ids))]

    def loss():
        states, kept, _ = lm.forward(p, ids, live, np.zeros((ids.shape[1], lm.HIDDEN)))
        out, g, d = lm.output(p, v, states, np.concatenate([ids[t, :k] for t, k in enumerate(live)]), True)
        return -out.mean(), lm.backward(p, ids, live, kept, d)

    _, (gu, gb, rows, gx) = loss()
    for name, at, g in (("u", (3, 20), gu[3, 20]), ("u", (5, 40), gu[5, 40]), ("b", (9,), gb[9]), ("x", (rows[1], 33), gx[1, 33])):
        p[name][at] += 1e-5
        up = loss()[0]
        p[name][at] -= 2e-5
        down = loss()[0]
        p[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(g, rel=1e-3, abs=1e-9)
