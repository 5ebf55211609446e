"""Byte-level BPE encoding and decoding as streaming transducers.

Encoding. A pre-token's bytes are merged in a buffer. A merge at some place can be upset from the right only by a
rule of lower rank whose text overlaps its end, that one only by a rule of still lower rank, and so on; `lookahead`
adds up the longest such chain in the merge list. A token that ends at least that many bytes before the end of
what was read can no longer change, so it is emitted and its bytes leave the buffer: memory depends on the merge list,
not on the text. Every pre-token goes this way; one shorter than the lookahead has its tokens emitted at its end. What
came out for short ones is remembered, up to a fixed number.

A text is read in parts of CHUNK bytes. What could still change (the last piece, or the last part of a pre-token that goes
on) is held back, so neither a text nor its ids are ever whole in Python, however long a text or a word is.

Decoding. Ids become bytes, and an incremental UTF-8 state machine turns bytes into text, so a character whose
bytes are dealt over several tokens, or over several calls, is put together. The round trip decodes each part as it is encoded.

The tokenizer file's path is a parameter; the file is read on the executors and never copied. Null texts count as
empty: no tokens, an empty text. Rows that repeat are kept as rows. Further columns are kept by `encode`; its own
columns take the place of columns with their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Remembered pre-tokens and pieces of text in one task's process; all of a kind are forgotten when there are more.
REMEMBER = {"pretokens": 300_000, "pieces": 300_000}
#: Longest pre-token, or piece, that is remembered (characters).
SHORT = 64
#: Bytes of a text that are read at once.
CHUNK = 1 << 16
#: Bytes that a stream reads before it looks for stable tokens, beyond the lookahead.
STEP = 4096
#: Bytes of texts in one batch.
BATCH = 8 << 20
#: A piece of more characters is taken apart before its end is known; so many of its last characters wait, as the next ones decide
#: about them (an apostrophe's ending, a special token's beginning).
LONG, WAIT = 4096, 32
NONE = 1 << 60
#: White space as the vocabulary's pattern sees it (Unicode's White_Space).
SPACE = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(parts: list[tuple[bytes, bytes]]) -> int:
    """Bytes to the right that can take part in the fate of a merge, at most.

    parts: each rule's two texts in order of rank. reach(rule) is its text's length plus the most that a chain of
    overlapping rules of ever lower ranks adds behind it.
    """
    ahead: dict[bytes, int] = {}  # of rules so far, by proper prefix: the longest reach
    most = 1
    for left, right in parts:
        text = left + right
        reach = len(text) + max((ahead.get(text[k:], 0) - (len(text) - k) for k in range(1, len(text))), default=0)
        reach = max(reach, len(text))
        most = max(most, reach)
        for k in range(1, len(text)):
            if ahead.get(text[:k], 0) < reach:
                ahead[text[:k]] = reach
    return most


class Vocabulary:
    """Merge ranks and token bytes of a tokenizers file with a byte-level BPE model and the usual pre-token pattern."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["model"]["type"] != "BPE":
            raise ValueError("expected a byte-level BPE file without normalizer")
        letters, ids = byte_letters(), spec["model"]["vocab"]
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: raw(t) for t, i in ids.items() if all(c in letters for c in t)}
        self.of_byte = [ids[next(c for c, b in letters.items() if b == k)] for k in range(256)]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        self.lookahead = lookahead([(raw(a), raw(b)) for a, b in merges])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.beginnings = {t[:k] for t in self.special for k in range(1, len(t))}
        self.space = regex.compile(f"[{SPACE}]*")
        if any(len(t) > WAIT for t in self.special):
            raise ValueError(f"special tokens of over {WAIT} characters")
        # A piece is a run without white space with one space before it, or white space; pre-tokens never cross pieces.
        self.pieces = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pretokens = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        # How a pre-token goes on, by its first character that isn't a space.
        self.kinds = [regex.compile(x) for x in (r"\p{L}*", r"\p{N}*", rf"[^{SPACE}\p{{L}}\p{{N}}]*", rf"[{SPACE}]*")]
        self.known = Pieces(self)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_few(v: Vocabulary, ids: list[int]) -> list[int]:
    """All merges of a short list of ids, the lowest rank first, the leftmost of equal ranks."""
    rank, made = v.rank.get, v.made
    ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
    while ranks:
        least = min(ranks)
        if least == NONE:
            break
        k = ranks.index(least)
        ids[k] = made[least]
        del ids[k + 1], ranks[k]
        if k:
            ranks[k - 1] = rank(ids[k - 1] << 32 | ids[k], NONE)
        if k < len(ranks):
            ranks[k] = rank(ids[k] << 32 | ids[k + 1], NONE)
    return ids


def _merge_many(v: Vocabulary, ids: list[int]) -> list[int]:
    n, rank = len(ids), v.rank.get
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 32 | ids[k + 1], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        if ids[k] < 0 or (j := after[k]) < 0 or rank(ids[k] << 32 | ids[j], NONE) != r:
            continue
        ids[k], ids[j], after[k] = v.made[r], -1, after[j]
        if after[k] >= 0:
            before[after[k]] = k
            if (r := rank(ids[k] << 32 | ids[after[k]], NONE)) != NONE:
                heapq.heappush(heap, (r, k))
        if before[k] >= 0 and (r := rank(ids[before[k]] << 32 | ids[k], NONE)) != NONE:
            heapq.heappush(heap, (r, before[k]))
    return [x for x in ids if x >= 0]


class Encoder:
    """Transducer from one pre-token's bytes to ids: push parts of it, then flush."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.buffer = v, bytearray()

    def _merge(self) -> list[int]:
        ids = list(map(self.v.of_byte.__getitem__, self.buffer))
        return _merge_few(self.v, ids) if len(ids) <= SHORT else _merge_many(self.v, ids)

    def push(self, more: bytes) -> Iterator[int]:
        step = self.v.lookahead + STEP
        for at in range(0, len(more), step):
            self.buffer += more[at : at + step]
            if len(self.buffer) < step:
                continue
            stable, end = len(self.buffer) - self.v.lookahead, 0
            for token in self._merge():
                if end + len(self.v.bytes_of[token]) > stable:
                    break
                end += len(self.v.bytes_of[token])
                yield token
            del self.buffer[:end]

    def flush(self) -> list[int]:
        out = self._merge()
        self.buffer.clear()
        return out


class PreTokens(dict):
    """Ids of pre-tokens as bytes; one that isn't there goes through the transducer."""

    def __init__(self, v: Vocabulary) -> None:
        self.encoder = Encoder(v)

    def __missing__(self, word: str) -> bytes:
        ids = _as_bytes([*self.encoder.push(word.encode()), *self.encoder.flush()])
        if len(word) <= SHORT:
            if len(self) >= REMEMBER["pretokens"]:
                self.clear()
            self[word] = ids
        return ids


class Pieces(dict):
    """Ids of pieces as bytes, put together from their pre-tokens."""

    def __init__(self, v: Vocabulary) -> None:
        self.cut, self.words = v.pretokens.findall, PreTokens(v)

    def __missing__(self, piece: str) -> bytes:
        one = (piece[1:] if piece[0] == " " else piece).isalpha()
        ids = self.words[piece] if one else b"".join(map(self.words.__getitem__, self.cut(piece)))
        if len(piece) <= SHORT:
            if len(self) >= REMEMBER["pieces"]:
                self.clear()
            self[piece] = ids
        return ids


class TextEncoder:
    """Transducer from a text to ids (little-endian, 32 bits): push its parts, the last one with last=True."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.held, self.open, self.kind = v, "", None, None

    def push(self, part: str, last: bool = False) -> bytes:
        text = self.held + part if self.held else part
        stop = len(text) if last else self._sure(text)
        rest, text = text[stop:], text[:stop]
        if any([s in text for s in self.v.special]):
            parts = self.v.special_pattern.split(text)
        else:
            parts = [text]
        out = []
        for k, x in enumerate(parts):
            out.append(self.v.special[x].to_bytes(4, "little") if k % 2 else self._plain(x, last or k < len(parts) - 1))
        self.held += rest
        return b"".join(out)

    def _sure(self, text: str) -> int:
        """Where what may be the beginning of a special token starts, at text's end, and the white space before it.

        That white space is one pre-token if the special token comes, else its last character goes with what follows.
        """
        tail = text[-WAIT:]
        at = next((k for k in range(len(tail)) if tail[k:] in self.v.beginnings), None)
        if at is None:
            return len(text)
        at += len(text) - len(tail)
        start = end = 0
        for m in self.v.special_pattern.finditer(text):
            start, end = m.span()
        if at < end:
            # Part of a whole special token: waits only if that may go on to a longer one.
            return start if end == len(text) and text[start:] in self.v.beginnings else len(text)
        while at > end and self.v.space.fullmatch(text[at - 1]):
            at -= 1
        return at

    def _plain(self, text: str, last: bool) -> bytes:
        """text without special tokens; unless it is the last before one, or of all, its end is held back."""
        out = []
        if self.open:
            text = self._go_on(text, last, out)
            if self.open:
                return b"".join(out)
        pieces = self.v.pieces.findall(text)
        self.held = pieces.pop() if pieces and not last else ""
        out += map(self.v.known.__getitem__, pieces)
        if len(self.held) > LONG:
            self._take_apart(out)
        return b"".join(out)

    def _take_apart(self, out: list[bytes]) -> None:
        """The pre-tokens of a long piece that are sure; the beginning of the last one, if that is long, too."""
        text, done = self.held, 0
        for m in self.v.pretokens.finditer(text):
            if m.end() > len(text) - WAIT:
                break
            out.append(self.v.known.words[m[0]])
            done = m.end()
        rest = text[done:]
        if len(rest) > LONG:
            first = rest.lstrip(" ")[:1]
            self.kind = next(x for x in self.v.kinds if first and x.fullmatch(first) or x is self.v.kinds[-1])
            self.open = Encoder(self.v)
            out.append(_as_bytes(self.open.push(rest[:-WAIT].encode())))
            rest = rest[-WAIT:]
        self.held = rest

    def _go_on(self, text: str, last: bool, out: list[bytes]) -> str:
        """Gives the open pre-token what belongs to it and returns the rest. It stays open if it may go on."""
        stop = self.kind.match(text).end()
        if stop == len(text) and not last:
            out.append(_as_bytes(self.open.push(text[:-WAIT].encode())))
            self.held = text[-WAIT:]
            return ""
        if self.kind is self.v.kinds[-1] and stop < len(text):
            stop -= 1  # the last white space goes with what follows
        out += [_as_bytes(self.open.push(text[:stop].encode())), _as_bytes(self.open.flush())]
        self.open = None
        return text[stop:]


def _as_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


def encode_parts(v: Vocabulary, text: bytes | memoryview) -> Iterator[bytes]:
    """ids of a text in UTF-8, part by part."""
    encoder, state = TextEncoder(v), codecs.getincrementaldecoder("utf-8")("replace")
    for at in range(0, len(text), CHUNK):
        last = at + CHUNK >= len(text)
        yield encoder.push(state.decode(text[at : at + CHUNK], last), last)


class Decoder:
    """State machine from ids to text; what isn't UTF-8 becomes U+FFFD."""

    def __init__(self, v: Vocabulary) -> None:
        self.bytes_of, self.state = v.bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def flush(self) -> str:
        return self.state.decode(b"", True)


def round_trip(v: Vocabulary, text: bytes | memoryview) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids and of the text that they decode to; each part is decoded as it comes."""
    n, ids, decoded, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(v)
    for part in encode_parts(v, text):
        n += len(part) // 4
        ids.update(part)
        decoded.update(decoder.push(np.frombuffer(part, "<u4").tolist()).encode())
    decoded.update(decoder.flush().encode())
    return n, ids.hexdigest(), decoded.hexdigest()


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, digests: bool = False) -> DataFrame:
    """docs with its ids in one more column `ids` (binary, little-endian 32 bit), or with their digests instead.

    digests: n_tokens, ids_sha256 and decoded_sha256 (of the ids decoded again) take the place of ids and the text;
    the other columns of docs stay.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    more = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"
    kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.binary()]

    def found(texts: pa.Array) -> list[pa.Array]:
        v = vocabulary(path)
        rows = [round_trip(v, x) if digests else (b"".join(encode_parts(v, x)),) for x in shared.views(texts)]
        return [pa.array(list(x), t) for x, t in zip(zip(*rows), kinds)]

    return shared.with_columns(docs, text_col, more, found, BATCH, drop=[text_col] if digests else [])


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(shared.table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
