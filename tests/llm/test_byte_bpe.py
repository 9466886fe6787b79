import public_tokenizers
import tiktoken
from tessera.llm import byte_bpe
from tessera.llm.catalogue import VOCABULARY

TEXTS = ["", "Hello world", "  two  spaces\n\n\nlines\t\ttabs ", "naïve Übergröße ñandú çà", "日本語のテキスト 😀😀", "1234567890 3.14", "don't we'll I'm", "x" * 5000, "ab" * 3000, "\x00\x01\x7f", "a b c", "<|endoftext|>"]


def reference():
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip_equal_the_library():
    own, other = byte_bpe.codec(VOCABULARY), reference()
    for text in TEXTS:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text), text[:40]
        assert own.decode(ids) == text.encode()


def test_merges_alone_agree_on_random_bytes():
    import random

    own, other, rng = byte_bpe.codec(VOCABULARY), reference(), random.Random(1)
    for _ in range(400):
        text = "".join(rng.choice("etaoin shrdluéüñ中文字éß.,!?0123\n") for _ in range(rng.randint(1, 80)))
        assert own.encode(text) == other.encode_ordinary(text)


def test_dataframe_with_nulls_clashing_columns_and_no_rows(spark):
    rows = [(1, "Hello world", 5, "a"), (2, None, 6, "b"), (3, "", 7, "c"), (3, "", 7, "c"), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    out = {(r.doc_id, r.n_tokens, bytes(r.decoded)) for r in byte_bpe.encode(df, vocabulary=VOCABULARY).collect()}
    assert (2, 0, b"") in out and (3, 0, b"") in out and any(i == 1 and d == b"Hello world" for i, _, d in out)
    assert byte_bpe.encode(df.limit(0), vocabulary=VOCABULARY).count() == 0


def test_long_texts_equal_the_library():
    """A megabyte without a space, of one letter, of ordinary words, and beyond what is listed at once."""
    import random

    own, other, rng = byte_bpe.codec(VOCABULARY), reference(), random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9)))
    for text in ("".join(rng.choice("etaoinshrdluéü") for _ in range(1_000_000)), "a" * 1_000_000, " ".join(word() for _ in range(180_000)), "\n".join(word() for _ in range(250_000))):
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
