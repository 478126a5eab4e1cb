import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loamwork.llm import packing, token_counts, token_files, units
from loamwork.llm.common import Workspace
from loamwork.llm.units import UnitEncoder, column_slices

ODD = ["", "\n", " ", " \n", "\n\n a", "a", "a  b", " a", "  a  b \n c ", "ﬁ①x", "a\tb", "<s> hi </s>", "日本語 テキスト\n", "x \ny", "▁a ▁", "tt▁ x", "​", "a<|endoftext|> b <|endoftext|>  c", "'s 't it's I'LL", "á ́b Σ ΟΔΟΣ. İ", "\x1c a\x1cb  \xa0 c", "a\u180eb \u180e c\u200bd e\ufefff g\u2028h\u3000i", " \t a\tb", "a \u180eb\u200b c \u2060d", "x" * 5000, "the and of " * 400]


def odd_texts(n=400):
    rng = random.Random(4)
    return ODD + ["".join(rng.choice("ab e\n\tthé日▁. 1,$") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_every_prefix_count_is_the_models():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, counter = SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    for text in odd_texts():
        deltas = counter.deltas([text])[0]
        assert len(deltas) == len(text)
        counts = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
        for n in range(1, len(text) + 1, 1 if len(text) < 100 else 97):
            assert counts[n - 1] == len(model.encode(text[:n]))
        for budget in (0, 3, 10):
            n = token_counts.longest_prefix(deltas, budget)
            assert len(model.encode(text[:n])) <= budget and all(c > budget for c in counts[n:])


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_units_give_the_librarys_ids(name, drops):
    path = public_tokenizers.path(name)
    own, library = UnitEncoder(path, drops), Tokenizer.from_file(path)
    texts = odd_texts() + ["Hallo,\nwelt.$$$ x|| <|endoftext|>. ééÉ### 1a2,,", "a<|b|> ..", "ǅ. ŉ, e\u0301. ǆ|"]
    for part in (texts, texts[::-1], [], [""], ["\n"]):  # the second time, units are known
        ids, ends = own.ids(pa.array(part, pa.string()))
        assert len(ends) == len(part)
        for text, of in zip(part, np.split(ids, ends[:-1]), strict=bool(part)):
            assert of.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_every_letter_before_and_after_every_mark(name, drops):
    """Code points up to U+2FFF, alone and behind a letter; U+0130's lower case is two code points."""
    path = public_tokenizers.path(name)
    own, library = UnitEncoder(path, drops), Tokenizer.from_file(path)
    texts = ["BELEDİYESİ.", "İ! İ|x aİ,b"] + [" ".join(f"{chr(c)}{m} a{chr(c)}{m} {m}{chr(c)} a{m}{chr(c)}b" for m in ".,;:!?#$%&*|") for c in range(0x3000)]
    want = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
    ids, ends = own.ids(pa.array(texts, pa.string()))
    for k, of in enumerate(np.split(ids, ends[:-1])):
        assert of.tolist() == want[k], texts[k]


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_units_give_the_librarys_ids_of_whole_documents(name, drops, monkeypatch):
    monkeypatch.setattr(units, "CACHE_UNITS", 20_000)
    monkeypatch.setattr(units, "KEPT_UNITS", 5_000)
    path = public_tokenizers.path(name)
    own, library = UnitEncoder(path, drops), Tokenizer.from_file(path)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks().fill_null("")
    want = [x.ids for x in library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
    at = 0
    for a, b in column_slices(texts, 1 << 19):
        ids, ends = own.ids(texts.slice(a, b - a))
        for of in np.split(ids, ends[:-1]):
            assert of.tolist() == want[at]
            at += 1
    assert at == len(want)


def test_streams_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_files.decode_stream(*token_files.encode_stream(v), n) == v).all()
    with pytest.raises(ValueError):
        token_files.decode_stream(b"\0", b"ab", 1)


def documents(spark, texts):
    rows = [(i, t, "x", i) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, shard long")


def test_prefix_table(spark):
    docs = documents(spark, [(1, "hello world"), (2, None), (2, None), (None, "a"), (3, "")])
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    fits = max(n for n in range(12) if len(model.encode("hello world"[:n])) <= 1)
    got = [tuple(r) for r in token_counts.prefix_table(docs, public_tokenizers.path("piece_bpe_32k.model"), budget=1, keep_deltas=False).collect()]
    assert sorted(got, key=str) == sorted([(1, 11, len(model.encode("hello world")), fits), (2, 0, 0, 0), (2, 0, 0, 0), (None, 1, 1, 1), (3, 0, 0, 0)], key=str)
    assert token_counts.prefix_table(docs.where("false"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 500)
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(k * 7 % 31, t) for k, t in enumerate(ODD)] + [(100, None), (50, "again"), (50, "again")]
    got = token_files.token_files(spark, documents(spark, texts), path, 2, keep_ids=True).collect()
    library, start = Tokenizer.from_file(path), 0
    assert len(got) == len(texts)
    of = {}
    for i, t in texts:
        of.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert bytes(r["ids"]) in of[r["doc_id"]] and r["start"] == start and r["n_tokens"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    assert token_files.token_files(spark, documents(spark, []), path).count() == 0


def test_token_files_without_ids_and_in_another_session(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, [(None, "b c"), (3, "a"), (None, None), (None, "b c"), (-4, "x")])
    folder = token_files.write_token_files(docs, path, 2, Workspace(spark, "test"))
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in token_files.read_token_files(spark.newSession(), folder, keep_ids=True).collect())
    library = Tokenizer.from_file(path)
    ids = lambda t: np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()
    assert [x for _, x, _ in got] == [None, None, None, -4, 3]
    assert sorted(x for _, _, x in got[:3]) == sorted([ids("b c"), ids(""), ids("b c")]) and [x for _, _, x in got[3:]] == [ids("x"), ids("a")]


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    keys = packing.hilbert_keys(cells, 3).astype(np.int64)
    assert sorted(keys.tolist()) == list(range(side**3))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    path, length = public_tokenizers.path("word_bpe_49k.json"), 64
    texts = [(k % 20, t) for k, t in enumerate(ODD)] + [(None, "a b"), (5, None)]
    pieces = packing.pack_along_curve(documents(spark, texts), path, 2, length, keep_ids=True)
    rows = pieces.collect()
    library = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for _, t in texts)
    seen, spans = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        seen.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for s, own in spans.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at == length or s == max(spans)
    stream = b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])))
    ids, docs, at = np.frombuffer(stream, "<u4"), [], 0
    starts = sorted((r["sequence_id"] * length + r["offset"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    for place, n in starts:
        assert place == at
        docs.append(zlib.crc32(ids[place : place + n].tobytes()))
        at = place + n
    assert sorted(docs) == want and at == len(ids)
    whole = packing.sequences(pieces, length).collect()
    assert {len(r["ids"]) for r in whole} == {4 * length} and sum(r["n_ids"] for r in whole) == len(ids)
    assert packing.pack_along_curve(documents(spark, []), path).count() == 0


def test_workspace(spark):
    ws = Workspace(spark, "test")
    df = ws.save(spark.range(3), "t")
    assert df.count() == 3
    ws.drop("t")
    with pytest.raises(Exception):
        spark.read.parquet(ws.path("t")).where(F.col("id") > 0).count()
