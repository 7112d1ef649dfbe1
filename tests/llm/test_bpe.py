import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sharelens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return t


def texts():
    r = random.Random(5)
    words = ["the", " the", "Ünïcode", "  ", "\n\n", "'s", "'re", "'", "!!", "日本語", "́", "🙂", "<|endoftext|>", "<|end", "1234", "_x_", "\t", " ", " ", "\U0001E6C0", "࢏", "\x00", "naïve"]
    yield from ["", " ", "a", "'", "it's 're x're", "   lead", "trail   ", "<|endoftext|><|endoftext|>", "�"]
    for _ in range(400):
        yield "".join(r.choice(words) for _ in range(r.randrange(1, 40)))
    for _ in range(60):
        yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(128, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(200))
    yield "x" * 3000 + "-" * 900 + " " * 700 + "ab" * 1500


def ids_of(text, vocabulary, size):
    e, out = bpe.Encoder(vocabulary), []
    for i in range(0, len(text), size):
        out += e.feed(text[i : i + size])
    out += e.end()
    return [int(x) for part in out for x in part.split(",")]


def test_ids_and_text_are_the_library_s(vocabulary, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        for size in (1 << 20, 7, 1):
            got = ids_of(text, vocabulary, size)
            assert got == want, (text, size)
        d = bpe.Decoder(vocabulary)
        assert "".join(d.feed([str(i)]) for i in want) + d.feed([], True) == library.decode(want, skip_special_tokens=False)


def test_broken_bytes_decode_as_the_library_does(vocabulary, library):
    r = random.Random(6)
    for _ in range(200):
        ids = [r.choice([*range(0, 256), 50256, r.randrange(50000)]) for _ in range(r.randrange(12))]
        d = bpe.Decoder(vocabulary)
        assert d.feed([str(i) for i in ids], True) == library.decode(ids, skip_special_tokens=False)


def test_long_pieces_are_streamed(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    for text in ["a" * 500 + " b", " " * 300 + "b", " " * 300, "!" * 400 + "'s", "q1" * 10 + "7" * 300 + "x", " " + "z" * 200 + "\n" * 200 + "y", *list(texts())[-70:]]:
        for size in (64, 113):
            assert ids_of(text, vocabulary, size) == library.encode(text, add_special_tokens=False).ids, text


def test_transducer_keeps_a_bounded_tail(vocabulary):
    p, out, most = bpe.Piece(vocabulary), [], 0
    for _ in range(60):
        out += p.feed(b"abcdefgh" * 64)
        most = max(most, len(p.data))
    assert most <= 4 * bpe.STEP + 2 * vocabulary.lookahead
    assert b"".join(vocabulary.bytes[i] for i in out + p.end()) == b"abcdefgh" * 64 * 60


def test_query(spark):
    rows = [(1, "Hello <|endoftext|> world's"), (2, None), (3, ""), (3, ""), (None, "ü" * 70)]
    out = bpe.transcode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids"), PATH)
    got = sorted(map(tuple, out.collect()), key=str)
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.transcode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_memory_is_bounded_by_the_lookahead(vocabulary, library):
    """One pre-token of any kind in small steps: what is kept never exceeds the computed lookahead, a token and a step."""
    r = random.Random(3)
    most = vocabulary.lookahead + max(vocabulary.sizes.values()) + 2 * bpe.STEP
    assert vocabulary.lookahead < 1000
    merged = [a + b for a, b in vocabulary.ranks if (a + b).isalpha()]
    for kind in ("letters", "tokens", "one", "two"):
        text = {"letters": lambda: "".join(r.choice("etaoinshr") for _ in range(20_000)), "tokens": lambda: b"".join(r.choice(merged) for _ in range(5_000)).decode(), "one": lambda: "a" * 20_000, "two": lambda: "ab" * 10_000}[kind]()
        p, out, kept = bpe.Piece(vocabulary), [], 0
        for i in range(0, len(text), 100):
            out += p.feed(text[i : i + 100].encode())
            kept = max(kept, len(p.data))
        assert out + p.end() == library.encode(text, add_special_tokens=False).ids
        assert kept <= most


def test_tokens_before_the_lookahead_never_change(vocabulary, library):
    """For random texts and continuations: tokens that end before the lookahead are in every continuation's encoding."""
    r = random.Random(4)
    merged = [t.decode() for t in (a + b for a, b in vocabulary.ranks) if t.isalpha() and t.isascii()]
    for _ in range(200):
        head = "".join(r.choice(merged) for _ in range(120))
        ids = library.encode(head, add_special_tokens=False).ids
        more = library.encode(head + "".join(r.choice(merged) for _ in range(5)), add_special_tokens=False).ids
        at = 0
        for a, b in zip(ids, more):
            at += vocabulary.sizes[a]
            if at > len(head) - vocabulary.lookahead:
                break
            assert a == b


def test_merges_out_of_order_are_refused():
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"c", b"ab"), (b"d", b"cab")]) == 3
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_a_full_table_keeps_what_is_asked_for_again(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE", 8)
    made = []
    monkeypatch.setattr(vocabulary, "encode", lambda raw, f=vocabulary.encode: made.append(raw) or f(raw))
    table = bpe._Table(vocabulary)
    for i in range(100):
        assert table["often"] == table["often"]
        assert table[f"w{i}"] == ",".join(map(str, bpe.Vocabulary.encode(vocabulary, f"w{i}".encode())))
        assert len(table) + len(table.old) <= 8
    assert made.count(b"often") == 1 and len(made) == 101


def test_short_pieces_in_one_step_are_those_of_the_tree(vocabulary):
    r = random.Random(8)
    tokens = [*vocabulary.ids]
    for _ in range(3000):
        data = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 5))) if r.random() < 0.5 else bytes(r.choice(b"etaoinsrh \xc3\xa9\xff") for _ in range(r.randrange(1, 40)))
        p = bpe.Piece(vocabulary)
        assert vocabulary.encode(data[: bpe.STEP]) == [*p.feed(data[: bpe.STEP]), *p.end()]


def test_latin_pieces_are_those_of_the_general_pattern():
    r = random.Random(9)
    for c in range(256):
        for text in (chr(c), f"a{chr(c)}b", f" {chr(c)} {chr(c)}1", f"'{chr(c)}", f"{chr(c)}{chr(c)}  "):
            assert bpe.LATIN.findall(text) == bpe.EXACT.findall(text)
    for _ in range(2000):
        text = "".join(r.choice(["'s", "'ll", " ", "\n", "\xa0", "\x85", "\x1c", "é", "ß", "²", "7", "x", "!", "ª", chr(r.randrange(256))]) for _ in range(30))
        assert bpe.LATIN.findall(text) == bpe.EXACT.findall(text)


def test_arrays_of_ids_decode_as_ids_do(vocabulary):
    r = random.Random(10)
    one, other = bpe.Decoder(vocabulary), bpe.Decoder(vocabulary)
    for _ in range(200):
        ids = [r.choice([*range(0, 256), 50256, r.randrange(50000)]) for _ in range(r.randrange(12))]
        assert one.feed_array(bpe.np.array(ids, int)) == other.feed([str(i) for i in ids])
