"""The transducer against the tiktoken library and plain merging, and the streaming decoder against Python's."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestream.llm import bpe_transducer as bpe
from lodestream.llm import queries

FILES = {"ranks": public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
DOC = "doc_id long, text string, ids int, decoded string, _text int"
ODD = "abcdeéñ中文字日本 \n\t'sll1230٣-–…🙂🇩🇪\u200b\x00\x1c\u00a0"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=FILES["pattern"], mergeable_ranks=bpe.read_ranks(FILES["ranks"]), special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(**FILES)


def odd_texts():
    rng = random.Random(5)
    short = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(1500)]
    runs = [c * n for c in ("a", "ab", "the", "中", " ", "=", "\n") for n in (1, 2, 3, 7, 64, 1025, 4100)]
    long = ["".join(rng.choice("abcdefgh") for _ in range(20_000)), "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(9_000)), " the<|endoftext|>end " * 3]
    return short + runs + long


def test_ids_are_the_library_s(library, codec):
    for text in odd_texts():
        ids = codec.encode(text).tolist()
        assert ids == library.encode_ordinary(text), text[:40]
        assert codec.decode(ids) == text


def test_a_long_text_goes_piece_by_piece(library, codec, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 10)
    for text in odd_texts()[-3:]:
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks_against_plain_merging(seed):
    """Random merges, among them tokens that merging never makes; tiny bounds, so that everything kept is emptied often."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 330:
        new = rng.choice(list(ranks)[97:101] + list(ranks)[256:]) + rng.choice(list(ranks)[97:101] + list(ranks)[256:])
        if len(new) <= 9:
            ranks.setdefault(new, len(ranks))
    ranks |= {b"abcdabcda"[:n]: 400 + n for n in (6, 9) if b"abcdabcda"[:n] not in ranks}
    machine = bpe.Transducer(ranks)
    for _ in range(400):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 60)))
        want = [ranks[p] for p in ([piece] if piece in ranks else bpe.merged(piece, ranks))]
        assert machine(piece) == want
        if piece not in ranks:
            cuts = sorted(rng.randrange(len(piece) + 1) for _ in range(3))
            parts = [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)]
            assert sum(machine.feed(parts), []) == want
    if seed == 0:
        assert len(machine.states) <= len(machine.token_at)


def test_tokens_are_emitted_after_a_bounded_lookahead(codec):
    machine, longest = codec.transducer, max(map(len, codec.transducer.ranks))
    rng = random.Random(2)
    run, sent = bpe.Run(machine), 0
    piece = "".join(rng.choice("etaoinshr") for _ in range(3000)).encode()
    out = []
    for i in range(0, len(piece), 8):
        run.take(piece[i : i + 8])
        out += (more := run.settle())
        sent += sum(machine.length[t] for t in more)
        assert i + 8 - sent <= 4 * longest
    assert out + run.finish() == codec.encode(piece.decode()).tolist()


def test_kept_verdicts_and_pieces_are_emptied_when_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 5)
    monkeypatch.setattr(bpe, "PIECES", 3)
    own = bpe.Codec(**FILES)
    for text in odd_texts()[:300]:
        assert own.encode(text).tolist() == library.encode_ordinary(text)
        assert len(own.pieces) <= 3 and sum(map(len, own.transducer.pairs.values())) <= 5


def test_utf8_machine_against_python():
    rng = random.Random(3)
    text = "aé中🙂\u07ff\u0800\uffff\U0010ffff".encode()
    for _ in range(3000):
        data = bytes(rng.choice(text) if rng.random() < 0.8 else rng.choice(b"\x80\xbf\xc0\xc1\xed\xa0\xf4\x90\xf5\xff\xe0\xf0") for _ in range(rng.randrange(12)))
        machine, got, i = bpe.Utf8(), "", 0
        while i < len(data):
            n = rng.randrange(1, 4)
            got += machine.feed(data[i : i + n])
            i += n
        assert got + machine.end() == data.decode("utf-8", "replace"), data


def test_decoder_against_python(codec):
    rng = random.Random(8)
    raw = codec.transducer.bytes_of
    for n in (0, 1, 255, 256, 257, 2000):
        for _ in range(20):
            ids = [rng.choice((rng.randrange(256), rng.randrange(50_000))) for _ in range(n)]
            want = b"".join(raw[i] for i in ids).decode("utf-8", "replace")
            assert codec.decode(ids) == want
            one_by_one = bpe.Decoder(raw)
            assert "".join(one_by_one.feed([i]) for i in ids) + one_by_one.end() == want


def test_rows(spark, library):
    texts = [(1, "hello world", 0, "x", 0), (1, "hello world", 0, "x", 0), (None, "né", 0, "x", 0), (2, None, 0, "x", 0), (3, "", 0, "x", 0), (4, "long wörd " * 40_000, 0, "x", 0)]
    got = bpe.encode_texts(spark.createDataFrame(texts, DOC), **FILES, with_decoded=True)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted((str(i), library.encode_ordinary(t or ""), t or "") for i, t, *_ in texts)
    assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert sorted((str(r[0]), r[2]) for r in bpe.decode_ids(got, **FILES).collect()) == [(i, t) for i, _, t in want]
    assert bpe.encode_texts(spark.createDataFrame([], DOC), **FILES).collect() == []
    broken = spark.createDataFrame([(1, [0, 1, 255]), (2, None), (3, [])], "k int, ids array<int>")
    raw = {i: t for t, i in bpe.read_ranks(FILES["ranks"]).items()}
    assert [r["decoded"] for r in bpe.decode_ids(broken, **FILES).orderBy("k").collect()] == [(raw[0] + raw[1] + raw[255]).decode("utf-8", "replace"), None, ""]


def test_query(spark, sf, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {r["doc_id"]: (len(ids := library.encode_ordinary(r["t"])), sha(",".join(map(str, ids))), sha(r["t"])) for r in docs}
