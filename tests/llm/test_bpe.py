"""Encoding by shared chunks against the library's own encoding of whole texts."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from gleanery.llm import bpe
from gleanery.llm.queries import word_model
from tests.conftest import values

PARTS = [
    "<|endoftext|>", "<|startoftext|>", "<|", "|>", "endoftext", "'", "l", "L", "'ll", "don't",
    "é", "́", "q̣̇", "가", "ᆨ", "각", "漢字", "İ", "ẞ", "ΑΣ", " ",
    "\n\t", "\x1c", "12", "½", "x" * 9, "Straße!", "😀👍🏽", "b c", "‍", "की", "ŉ", "\x85", "...",
]


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(word_model())
    found.no_truncation()
    found.no_padding()
    return found


def whole(library, text):
    code = library.encode(text or "", add_special_tokens=False)
    return " ".join(map(str, code.ids)), library.decode(code.ids, skip_special_tokens=False)


def test_joins_of_tiny_chunks(library, monkeypatch):
    for name, value in dict(SHORTEST=1, SELECTIVITY=2, WINDOW=1, RIM=8, EDGE=2).items():
        monkeypatch.setattr(bpe, name, value)
    rng, code = random.Random(3), bpe.Coder(word_model())
    few = ["don'", "t", "l", "ll", " ", "<|", "endoftext", "|>", "a", "1"]
    joins = 0
    for n in range(3000):
        text = "".join(rng.choices(few if n % 3 else PARTS, k=rng.randrange(0, 50)))
        joins += len(bpe.cuts(text))
        assert bpe.encoded(code, text) == whole(library, text), text
        packed = bpe.unpack(code, *bpe.pack(code, text))
        assert packed == code.items(text)
    assert joins > 5000


def test_long_texts_and_cuts_by_content(library):
    rng, code = random.Random(4), bpe.Coder(word_model())
    passage = " ".join("".join(rng.choices("abcdeéß", k=rng.randrange(1, 9))) for _ in range(4000))
    texts = [passage, "x" * 30_000, "漢" * 5000, "one " * 9000, "before it. " + passage + " after"]
    for text in texts:
        assert bpe.encoded(code, text) == whole(library, text)
    first, last = ({bpe.chunk_hash(c) for c in bpe.chunks(t)} for t in (texts[0], texts[-1]))
    assert len(first) > 10 and len(first & last) >= len(first) - 2


@pytest.mark.parametrize("shared_bytes", [bpe.SHARED_BYTES, 0])
def test_documents(spark, library, shared_bytes):
    rng = random.Random(5)
    passages = [" ".join("".join(rng.choices("abcdefgé'", k=rng.randrange(1, 9)))
                         for _ in range(900)) for _ in range(3)]
    rows = [(i, rng.choice(["", "Own words. ", "Other\n"]) + rng.choice(passages)
             + " ".join(rng.choices(PARTS, k=30))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n"), (None, "no id"), (7, "twice"), (7, "twice")]
    rows += [(i, passages[0]) for i in range(50, 60)]
    docs = spark.createDataFrame([(*r, "k", b"h") for r in rows],
                                 "doc_id long, text string, key string, hash binary")
    assert bpe.shared_chunks(docs, word_model, shared_bytes=shared_bytes).count() > 5
    got = bpe.encode_texts(docs, word_model, shared_bytes=shared_bytes)
    want = [(i, len(ids.split()), ids, text) for i, (ids, text) in
            ((i, whole(library, t)) for i, t in rows)]
    assert values(got, "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)


def test_token_ids_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_texts(docs, word_model).collect() == []
    one = spark.createDataFrame([("",), ("5 49407",)], "ids string")
    got = one.select(bpe.token_ids(one["ids"]).alias("ids"))
    assert [r["ids"] for r in got.collect()] == [[], [5, 49407]]


def test_other_files_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, library):
    from gleanery.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.op13_bpe_round_trip(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = {}
    for row in docs:
        ids, text = whole(library, row["text"])
        want[row["doc_id"]] = (len(ids.split()), hashlib.sha256(ids.encode()).hexdigest(),
                               hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
