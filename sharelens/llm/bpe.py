"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding. A split into tokens is the merge list's own exactly if each adjacent pair of tokens is what the merges
make of the pair's bytes. So the last token of each prefix's encoding is the one token that ends there and goes with
the last token before it, and encodings of all prefixes form a tree. `sufficient_lookahead` computes from the merge list how many
bytes at the end of a prefix its continuation can change at most; tokens that end before are emitted, and the transducer
keeps only those bytes, one token and one step, whatever the text's length.

`Encoder.feed` takes text in pieces of any size: it holds back what the split into pre-tokens (a fixed pattern) or
special tokens may still change, at most a few characters, and streams a pre-token of more than LONG characters.
`Decoder.feed` turns ids into bytes and runs a UTF-8 state machine of at most three pending bytes; bytes that
form no character become U+FFFD as late as they are known to.

A short pre-token runs in one step, from its beginning: the longest token that goes with the one before is taken, and where no token
follows, the next shorter one. As a prefix has one encoding, an end that leads nowhere is never tried again.

Pre-tokens repeat, so their ids are kept in a table of bounded size, in two halves of which the older one goes when the younger is full.

Defined cases: null text is the empty text, which has no tokens (hashes of the empty string); null or repeated
doc_ids and repeated rows come back as they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, lean

# Code points that became letters or numbers only in Unicode 17; the tokenizers have Unicode 16.
NEW_LETTERS = (
    r"\U00000558\U0000058B-\U0000058C\U0000088F\U00000C5C\U00000CDC\U0000208F\U0000209D-\U0000209F\U0000A7CE-\U0000A7CF\U0000A7D2\U0000A7D4\U0000A7DD\U0000A7E2\U0000A7F1\U0000AB6C-\U0000AB6D"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DF1\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF3"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24"
    r"\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)
NEW_NUMBERS = r"\U00011DE0-\U00011DE9\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016FF4-\U00016FF6"
_L, _N = rf"[\p{{L}}--[{NEW_LETTERS}]]", rf"[\p{{N}}--[{NEW_NUMBERS}]]"
_P = rf"[^\s\p{{L}}\p{{N}}{NEW_LETTERS}{NEW_NUMBERS}]|[{NEW_LETTERS}{NEW_NUMBERS}]"
FAST = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
# the same for texts without characters beyond U+00FF
_S1, _L1, _N1 = r"\t-\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L1}]+| ?[{_N1}]+| ?[^{_S1}{_L1}{_N1}]+|[{_S1}]+(?![^{_S1}])|[{_S1}]+")
WIDE = re.compile("[^\x00-\xff]")
EXACT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?(?:{_P})+|\s+(?!\S)|\s+", regex.V1)
NEW = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
HIGH = re.compile("[\u0558-\U0010FFFF]")
CLASSES = [regex.compile(x, regex.V1) for x in (rf"{_L}+", rf"{_N}+", rf"(?:{_P})+", r"\s+")]

#: Characters of a pre-token from which on it is streamed; entries of the table of pre-tokens; bytes between emissions.
LONG, TABLE, STEP = 1 << 16, 450_000, 256
#: Bytes at a token's beginning that tell how long it gets at most.
HEAD = 4
#: Kept answers about pairs of tokens; marks for the beginning of a pre-token and for a prefix without an encoding.
PAIRS, START, NONE = 600_000, 1 << 19, -1


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes, in order, for the characters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """The most bytes before a prefix's end that what follows can change.

    Merge a prefix with and without a continuation, rule by rule. Both have the same tokens up to a front, at first the
    prefix's end, and within them the same merges. A rule (x, y) moves the front only if the last common token is x and in one of
    the two a y follows, by the length of x; at a front moved there by a rule (x', .), y begins with x', and that rule came
    before. So the longest chain of rules with such left parts, in bytes, bounds the front's way. It takes merges in which
    tokens are made before they are used (else a ValueError)."""
    way: dict[bytes, int] = {}
    made: set[bytes] = set()
    most = 0
    for x, y in merges:
        if any(len(t) > 1 and t not in made for t in (x, y)):
            raise ValueError("a merge uses a token that no earlier one makes")
        made.add(x + y)
        here = len(x) + max(way.get(y[:i], 0) for i in range(1, len(y) + 1))
        way[x] = max(way.get(x, 0), here)
        most = max(most, here)
    return most


class Vocabulary:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda t: bytes(letters[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: c.encode() for c, i in self.special.items()}
        self.lookahead = sufficient_lookahead([*self.ranks])
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        self.sizes = {i: len(t) for i, t in self.bytes.items()}
        self.pairs: dict[int, bool] = {}
        # the longest token that is a proper prefix of each token, and how long tokens with these first HEAD bytes get
        self.shorter = {i: next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ids), None) for t, i in self.ids.items()}
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > HEAD:
                self.reach[t[:HEAD]] = max(self.reach.get(t[:HEAD], 0), len(t))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.texts = {str(i): t for i, t in self.bytes.items()}
        tokens = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.flat, self.length = np.frombuffer(b"".join(tokens), np.uint8), np.array([*map(len, tokens)], np.int64)
        self.begin = np.cumsum(self.length) - self.length

    def merged(self, data: bytes) -> list[bytes]:
        """The merges, lowest rank first, leftmost first; for a token or a pair of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, 1 << 60
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (rank := min(ranks)) != none:
            at = ranks.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def goes(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are; before is START at the beginning of a pre-token."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        b = self.bytes[token]
        got = self.merged(b) == [b] if before == START else self.merged(self.bytes[before] + b) == [self.bytes[before], b]
        self.pairs[before << 20 | token] = got
        return got

    def extend(self, data: bytes, last: list[int], ends: range) -> None:
        """Appends to `last` the id of the last token of each prefix's encoding, NONE where there is none. Longest tokens are
        tried first: only one goes with what is before it."""
        tails, ids, pairs = self.tails, self.ids.get, self.pairs.get
        for end in ends:
            start = end - 1
            while start and data[start - 1 : end] in tails:
                start -= 1
            for s in range(start, end):
                token = ids(data[s:end])
                if token is not None and (before := last[s]) != NONE:
                    ok = pairs(before << 20 | token)
                    if ok or ok is None and self.goes(before, token):
                        last.append(token)
                        break
            else:
                last.append(NONE)

    def encode(self, data: bytes) -> list[int]:
        """A short pre-token at once."""
        token = self.ids.get(data)
        if token is not None and (self.pairs.get(START << 20 | token) or self.goes(START, token)):
            return [token]
        get, pairs, reach, sizes, shorter = self.ids.get, self.pairs.get, self.reach.get, self.sizes, self.shorter
        path, before, at, n, dead, fresh = [], START, 0, len(data), set(), True
        while at < n:
            if fresh:  # the longest token from here
                end = min(n, at + reach(data[at : at + HEAD], HEAD))
                while (token := get(data[at:end])) is None and end > at:
                    end -= 1
            while token is not None:
                ok = pairs(before << 20 | token)
                if (ok or ok is None and self.goes(before, token)) and not (dead and at + sizes[token] in dead):
                    break
                token = shorter[token]
            if fresh := token is not None:
                path.append(token)
                before, at = token, at + sizes[token]
            else:
                dead.add(at)
                token = path.pop()
                before, at, token = path[-1] if path else START, at - sizes[token], shorter[token]
        return path

    def path(self, last: list[int], at: int) -> list[int]:
        """The ids up to `at`, from the tree of last tokens."""
        out = []
        while at > 0:
            out.append(last[at])
            at -= self.sizes[last[at]]
        return out[::-1]


class Piece:
    """The transducer for one pre-token."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.data, self.last = vocabulary, b"", [START]

    def feed(self, data: bytes):
        """Yields the ids that have become certain."""
        for at in range(0, len(data), STEP):
            self.data += data[at : at + STEP]
            self.v.extend(self.data, self.last, range(len(self.last), len(self.data) + 1))
            if len(self.data) > self.v.lookahead + STEP:
                at = len(self.data)
                while at > len(self.data) - self.v.lookahead:
                    at -= self.v.sizes[self.last[at]]
                yield from self.v.path(self.last, at)
                self.data, self.last = self.data[at:], self.last[at:]

    def end(self) -> list[int]:
        return self.v.path(self.last, len(self.data))


class _Table(dict):
    """Pre-token to its ids as text; entries come from the transducer. Half of TABLE are the younger ones; when there are more, they become the
    older half, from which those that are asked for again come back."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.old = vocabulary, {}

    def __missing__(self, piece: str) -> str:
        got = self.old.get(piece)
        if got is None:
            raw = piece.encode()
            if len(raw) <= STEP:
                ids = self.v.encode(raw)
            else:
                p = Piece(self.v)
                ids = [*p.feed(raw), *p.end()]
            got = ",".join(map(str, ids))
        if len(self) >= TABLE // 2:
            self.old = dict(self)
            self.clear()
        self[piece] = got
        return got


class Encoder:
    """Text in parts of any size to ids; feed and end return lists of comma-joined decimal ids."""

    def __init__(self, vocabulary: Vocabulary, table: _Table | None = None):
        self.v, self.table = vocabulary, table if table is not None else _Table(vocabulary)
        self.held, self.open, self.kind = "", None, None
        self.keep = max(map(len, vocabulary.special), default=1) - 1

    def feed(self, text: str, last: bool = False) -> list[str]:
        self.held += text
        out: list[str] = []
        while self.v.special_pattern and (m := self.v.special_pattern.search(self.held)):
            before, self.held = self.held[: m.start()], self.held[m.end() :]
            self._plain(before, True, out)
            out.append(str(self.v.special[m[0]]))
        if last:
            self._plain(self.held, True, out)
            self.held = ""
        else:  # the end may be the beginning of a special token
            cut = max(0, len(self.held) - self.keep)
            self.held = self._plain(self.held[:cut], False, out) + self.held[cut:]
        return out

    def end(self) -> list[str]:
        return self.feed("", True)

    def _plain(self, text: str, last: bool, out: list[str]) -> str:
        """Appends the ids of the certain pre-tokens; returns the rest."""
        if self.open:
            text = self._continue(text, last, out)
            if self.open or not text:
                return text
        if text.isascii() or not WIDE.search(text):
            pattern = LATIN
        else:
            pattern = FAST if not HIGH.search(text) or not NEW.search(text) else EXACT
        pieces = pattern.findall(text)
        if not last:  # a pre-token may change while three characters or less follow its end
            tail = 0
            while pieces and tail < 3:
                tail += len(pieces.pop())
            if tail > LONG:
                out += map(self.table.__getitem__, pieces)
                return self._begin(text[len(text) - tail :], out)
        out += map(self.table.__getitem__, pieces)
        return "" if last else text[len(text) - tail :]

    def _begin(self, text: str, out: list[str]) -> str:
        first = EXACT.match(text)[0]
        if len(first) <= LONG:
            out.append(self.table[first])
            text = text[len(first) :]
        at = 1 if text[0] == " " and len(text) > 1 and not text[1].isspace() else 0
        self.kind = next(c for c in CLASSES if c.match(text, at))
        self.open, self.text_at = Piece(self.v), at
        head, text = text[:at], text[at:]
        out += map(str, self.open.feed(head.encode()))
        return self._continue(text, False, out)

    def _continue(self, text: str, last: bool, out: list[str]) -> str:
        m = self.kind.match(text)
        end = m.end() if m else 0
        over = last or end < len(text)
        if self.kind is CLASSES[3] and end and (end < len(text) or not last):
            end -= 1  # the last space belongs to what follows, unless nothing does
        out += map(str, self.open.feed(text[:end].encode()))
        if over:
            out += map(str, self.open.end())
            self.open = None
        return text[end:]


class Decoder:
    """Ids to text as they come."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.machine = vocabulary, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[str], last: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.v.texts.__getitem__, ids)), last)

    def feed_array(self, ids: np.ndarray) -> str:
        """The same for an array of ids."""
        n = self.v.length[ids]
        end = np.cumsum(n)
        return self.machine.decode(self.v.flat[np.arange(end[-1]) + np.repeat(self.v.begin[ids] - end + n, n)].tobytes()) if len(ids) else ""


_HELD: dict[str, tuple[Vocabulary, _Table]] = {}


def held(raw: bytes) -> tuple[Vocabulary, _Table]:
    """The vocabulary of this process, built once."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _HELD:
        v = Vocabulary(raw)
        _HELD[key] = (v, _Table(v))
    return _HELD[key]


#: Characters and ids that go through the transducers at once.
PART = 1 << 20


def encode(text: str, vocabulary: Vocabulary, table: _Table | None = None):
    """Yields parts of the ids of one text, as comma-joined decimals."""
    e = Encoder(vocabulary, table)
    for at in range(0, len(text), PART):
        if got := e.feed(text[at : at + PART], at + PART >= len(text)):
            yield ",".join(got)


def transcode(docs: DataFrame, path: str, keep: tuple[str, ...] = (), ids: bool = False) -> DataFrame:
    """doc_id (and `keep`), n_tokens, ids_sha256, decoded_sha256; with ids also the ids, an array of int.

    `path` names the vocabulary file on the driver; its content, of fixed size, goes to the executors as a broadcast."""
    spark = docs.sparkSession
    configure(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        import pyarrow as pa

        vocabulary, table = held(shared.value)
        for batch in batches:
            counts, hashes, decoded, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                n, a, b, d, own = 0, hashlib.sha256(), hashlib.sha256(), Decoder(vocabulary), []
                for part in encode(text or "", vocabulary, table):
                    a.update((f",{part}" if n else part).encode())
                    tokens = np.fromstring(part, np.int32, sep=",")
                    n += len(tokens)
                    b.update(d.feed_array(tokens).encode())
                    if ids:
                        own += tokens.tolist()
                b.update(d.feed([], True).encode())
                counts.append(n)
                hashes.append(a.hexdigest())
                decoded.append(b.hexdigest())
                all_ids.append(own)
            columns = [batch.column(c) for c in ("doc_id", *keep)]
            columns += [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if ids else []), names)

    names = ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    source = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(lean(run), f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else ""))
