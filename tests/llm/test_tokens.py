import random

import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tributary.llm import tokens

PATH = tokens.tokenizer_path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return tokens.StreamingEncoder(PATH, public.PATTERN, piece=16)


@pytest.fixture(scope="module")
def brute():
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


CASES = [
    "a" * 3000,
    "abcdefgh" * 200,
    " " * 500 + "x",
    "\n" * 200 + " word",
    "it's they'll 'sabcdefghijklmnopqrstuvwxyzabcdefgh'tail" * 3,
    "'" + "s" * 100,
    "温暖的陶罐的仓库指南" * 30,
    "<|endoftext|> stays text <|endoftext|>",
    "mixed 123456789012345678901234567890 ---===---===---===---=== end\t\t\t\r\n  x",
    "👩‍🌾" * 40,
    "é" * 60,
]


@pytest.mark.parametrize("text", CASES)
def test_long_runs_equal_the_plain_tokenizer(encoder, brute, text):
    assert encoder.encode(text) == brute(text)


def test_random_texts_equal_the_plain_tokenizer(encoder, brute):
    rng = random.Random(5)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcde ", "thein ", "a1 -'\n", "éüа温x ", "0123456789"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200)))
        assert encoder.encode(text) == brute(text), text


RUNS = ["unbreakable" * 100, "a" * 3000, "-=" * 900 + "=" * 300, "ÃÂ" * 400, "0123456789" * 150, "温暖的陶罐" * 80]


@pytest.mark.parametrize("run", RUNS)
def test_memory_is_bounded_by_the_lookahead(encoder, brute, run):
    inner = tokens.Transducer(encoder.merges)
    longest = max(map(len, encoder.merges.ranks))
    data, out = run.encode(), []
    for i in range(0, len(data), 7):
        out += inner.feed(data[i : i + 7])
        assert inner.held <= encoder.merges.lookahead + longest
    assert len(out) > 0
    assert out + inner.close() == brute(run)


def test_no_later_byte_reaches_back_beyond_the_lookahead(encoder):
    rng = random.Random(8)
    for alphabet in ("ab", "-=", "ÃÂ", "thein", "0123456789", "еинт", "\n "):
        data = "".join(rng.choice(alphabet) for _ in range(900)).encode()
        whole = tokens.Transducer(encoder.merges)
        whole._held = data
        for n in range(1, len(data) + 1):
            whole._extend(data, n)
        ends = {e for e, _ in whole._ids(len(data))}
        for n in range(1, len(data), 5):
            assert all(e in ends for e, _ in whole._ids(n) if e <= n - encoder.merges.lookahead)


def test_every_id_comes_from_the_transducer(brute):
    encoder = tokens.StreamingEncoder(PATH, public.PATTERN, remembered=2)
    text = "one two one two three " * 5
    assert encoder.encode(text) == brute(text)
    assert encoder.transduced >= 10  # the memory was emptied again and again
    encoder = tokens.StreamingEncoder(PATH, public.PATTERN)
    assert encoder.encode(text) == brute(text) and encoder.transduced == len(set(text.split())) + 2 - 0


def test_any_pre_tokenizer(brute):
    import tiktoken

    pattern = r"\p{L}+|\s|[^\s\p{L}]{1,3}"
    encoder = tokens.StreamingEncoder(PATH, pattern, piece=16)
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=encoder.merges.ranks, special_tokens={})
    for text in [*CASES, "x" * 9000 + " 12345678 ..."]:
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_a_second_vocabulary():
    import tiktoken

    path = tokens.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    encoder = tokens.StreamingEncoder(path, public.PATTERN)
    library = tiktoken.Encoding("multi", pat_str=public.PATTERN, mergeable_ranks=encoder.merges.ranks, special_tokens={})
    for text in CASES:
        assert encoder.encode(text) == library.encode_ordinary(text)
    with pytest.raises(ValueError, match="every byte"):
        tokens.Merges({b"a": 0})


def test_decoder_is_the_inverse(encoder):
    decoder = tokens.StreamingDecoder(encoder.merges.tokens)
    for text in CASES:
        assert "".join(decoder.decode(encoder.encode(text))) == text


def test_corpus_with_null_empty_repeated_and_clashing(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (2, "", None), (None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = tokens.encode_corpus(df)
    got = sorted(out.collect(), key=str)
    assert [(r.doc_id, list(r.ids)) for r in got] == [(1, [64, 275]), (1, [64, 275]), (2, []), (None, [])]
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    back = tokens.decode_corpus(out).collect()
    assert sorted(str(r.text) for r in back) == ["", "", "a b", "a b"]
