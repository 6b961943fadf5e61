"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding applies a merge list: of all neighbouring symbols the pair of the lowest rank, leftmost first, is merged. Whether
a token that ends at some place survives depends on a bounded number of symbols after it. `sufficient_lookahead` bounds
that number from the merge list alone, in rank order: a rule (u, v) makes what is to the right of u matter to u (the
length of v and what v itself depends on), and what u depends on matter to v, less the length of v. Every word goes
through a transducer with a buffer of constant size; tokens are emitted once that many symbols follow them or the word
ends. As no merge crosses an emitted boundary, the rest is encoded as if it stood alone. Words met before are looked up in
a table of bounded size.

A text is read in blocks of BLOCK bytes, cut after white space. A stretch of more than LONG characters without any is
normalised, split into words and merged piece by piece, each step holding back what the next characters can change.
Beside the text itself, memory follows BLOCK, LONG and the table, not the text (a run of combining marks without end
would be held, as they are put in order).

Decoding is a state machine from ids to text: it holds the bytes of a character that isn't complete yet, nothing else.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, keeps, pieces, private, raw_texts, tidy

WORD_END = "</w>"
MEMO = 400_000  # stretches of text in each of a worker's two generations
BLOCK = 1 << 16  # bytes of text read at once
LONG = 4096  # characters without white space from which a stretch is taken piece by piece
NONE = 1 << 62


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a token's end that can decide whether it survives; length(token) counts symbols."""
    need: dict[str, int] = {}
    for u, v in merges:
        cu, cv, size = need.get(u, 0), need.get(v, 0), length(v)
        made = u + v
        need[made] = max(need.get(made, 0), cv, cu - size)
        need[u] = max(cu, size + cv)
        need[v] = max(need.get(v, 0), cu - size)
    return max(need.values(), default=0)


class Vocabulary:
    """What a tokenizer file of this kind says: ids, ranks, special tokens, and the derived lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.lookahead = sufficient_lookahead(merges, lambda t: len(t.removesuffix(WORD_END)))
        self.rules = {self.ids[a] << 32 | self.ids[b]: (rank << 32 | self.ids[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        alphabet = byte_alphabet()
        self.byte_ids = [self.ids[alphabet[b]] for b in range(256)]
        self.last_ids = [self.ids[alphabet[b] + WORD_END] for b in range(256)]
        self.tokens: list[str] = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, k in [*self.ids.items(), *self.special.items()]:
            self.tokens[k] = t
        back = {c: b for b, c in alphabet.items()}
        specials = set(self.special.values())
        self.token_bytes = [t.encode() if k in specials else bytes(back[c] for c in t.removesuffix(WORD_END)) + b" " * t.endswith(WORD_END) for k, t in enumerate(self.tokens)]
        self.library_bytes = [t.encode() for t in self.tokens]
        self.decimal = [b"%d" % k for k in range(len(self.tokens))]


def merge(symbols: list[int], rules: dict[int, int]) -> list[int]:
    """Applies the merge list to symbols: lowest rank first, the leftmost of equals."""
    get = rules.get
    ranks = [get(a << 32 | b, NONE) for a, b in zip(symbols, symbols[1:])]  # noqa: B905, RUF007
    while ranks:
        best = min(ranks)
        if best == NONE:
            break
        k = ranks.index(best)
        made = symbols[k] = best & 0xFFFFFFFF
        del symbols[k + 1], ranks[k]
        if k < len(ranks):
            ranks[k] = get(made << 32 | symbols[k + 1], NONE)
        if k:
            ranks[k - 1] = get(symbols[k - 1] << 32 | made, NONE)
    return symbols


def merge_long(symbols: list[int], rules: dict[int, int]) -> list[int]:
    """merge() with a heap over linked symbols, for buffers of many symbols."""
    n = len(symbols)
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    heap = [(rule >> 32, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (rule := rules.get(symbols[k] << 32 | symbols[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, a, b = heapq.heappop(heap)
        right = after[k]
        if not alive[k] or right < 0 or symbols[k] != a or symbols[right] != b:
            continue
        symbols[k] = rules[a << 32 | b] & 0xFFFFFFFF
        alive[right] = False
        after[k] = after[right]
        if after[k] >= 0:
            before[after[k]] = k
            if (rule := rules.get(symbols[k] << 32 | symbols[after[k]])) is not None:
                heapq.heappush(heap, (rule >> 32, k, symbols[k], symbols[after[k]]))
        if before[k] >= 0 and (rule := rules.get(symbols[before[k]] << 32 | symbols[k])) is not None:
            heapq.heappush(heap, (rule >> 32, before[k], symbols[before[k]], symbols[k]))
    return [s for s, x in zip(symbols, alive, strict=True) if x]


class WordTransducer:
    """Encodes the bytes of one word given in parts; push() and finish() yield ids as soon as they are stable."""

    def __init__(self, vocabulary: Vocabulary, buffer: int | None = None):
        self.v = vocabulary
        self.lookahead = vocabulary.lookahead
        self.buffer = buffer or max(1024, 4 * self.lookahead)
        self.symbols: list[int] = []
        self.spare = b""  # the last byte so far: it may be the word's last

    def push(self, data: bytes) -> Iterator[int]:
        data = self.spare + data
        self.spare, data = data[-1:], data[:-1]
        ids = self.v.byte_ids
        for at in range(0, len(data), self.buffer):
            self.symbols += [ids[b] for b in data[at : at + self.buffer]]
            if len(self.symbols) > self.buffer + self.lookahead:
                yield from self._emit()

    def _emit(self) -> Iterator[int]:
        stable, done = len(self.symbols) - self.lookahead, 0
        for token in merge_long(self.symbols[:], self.v.rules):
            size = len(self.v.token_bytes[token])
            if done + size > stable:
                break
            yield token
            done += size
        del self.symbols[:done]

    def finish(self) -> list[int]:
        symbols = self.symbols + [self.v.last_ids[b] for b in self.spare]
        self.symbols, self.spare = [], b""
        return merge_long(symbols, self.v.rules) if len(symbols) > 64 else merge(symbols, self.v.rules)


class Encoder:
    """Text to ids: special tokens, NFC, lower case, words, merges. Words are remembered, in a memo of bounded size."""

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    ODD_SPACE = "\x1c\x1d\x1e\x1f"  # space for str.split(), not for the tokenizer
    SPACE = regex.compile(r"\s+")

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO):
        self.v, self.most = vocabulary, memo
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.words: dict[str, bytes] = {}  # by stretch; older ones move to the second dictionary
        self.old: dict[str, bytes] = {}
        self.machine = WordTransducer(vocabulary)
        self.marks = {m: array("i", self._word(m)).tobytes() for m in ".,;:!?"}

    def _word(self, word: str) -> list[int]:
        machine = self.machine
        out = [*machine.push(word.encode("utf-8", "replace"))]
        return out + machine.finish()

    def chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit ids of a stretch without white space, normalised already."""
        if chunk.isalpha():
            return array("i", self._word(chunk)).tobytes()
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # a word and a mark, which are words of their own
            return (self.words.get(chunk[:-1]) or self.old.get(chunk[:-1]) or self.chunk(chunk[:-1])) + self.marks[chunk[-1]]
        return array("i", [t for word in self.SPLIT.findall(chunk) for t in self._word(word)]).tobytes()

    def stream(self, raw: bytes) -> Iterator[bytes]:
        """Little-endian 32-bit ids of a whole UTF-8 text, in parts, as they become stable."""
        if len(raw) <= BLOCK:
            yield self.block(raw.decode("utf-8", "replace"))
            return
        decoder, text = codecs.getincrementaldecoder("utf-8")("replace"), _Text(self)
        view = memoryview(raw)
        for at in range(0, len(raw), BLOCK):
            yield from text.push(decoder.decode(view[at : at + BLOCK]))
        yield from text.push(decoder.decode(b"", True))
        yield from text.finish()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.stream(text.encode("utf-8", "replace"))), "<i4")

    def block(self, text: str) -> bytes:
        """Ids of a text with all its words whole."""
        out: list[bytes] = []
        parts = self.special.split(text) if self.special and "<|" in text else (text,)
        for part in parts:
            if (own := self.v.special.get(part)) is not None:
                out.append(np.array([own], "<i4").tobytes())
                continue
            if not part.isascii():
                if not unicodedata.is_normalized("NFC", part):
                    part = unicodedata.normalize("NFC", part)
                part = part.replace("Σ", "σ")  # lower() would look at a capital sigma's neighbours
            part = part.lower()
            chunks = part.split() if not any(c in part for c in self.ODD_SPACE) else [c for c in self.SPACE.split(part) if c]
            words = self.words
            if new := set(chunks).difference(words):
                if len(words) > self.most:
                    self.old, self.words = words, {}
                    words, new = self.words, set(chunks)
                old = self.old
                for c in new:
                    words[c] = old[c] if c in old else self.chunk(c)
            out.append(b"".join(map(words.__getitem__, chunks)))
            for c in new:
                if len(c) > 64:
                    del words[c]
        return b"".join(out)


@lru_cache(1)
def _composing() -> frozenset[str]:
    """Characters that may compose with the one before, and so can't begin a part that is normalised alone."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset([chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")] + [chr(c) for c in range(0x1161, 0x11C3)])


def _starts_anew(c: str) -> bool:
    return c < "\x80" or (unicodedata.combining(c) == 0 and c not in _composing())


class _Text:
    """Blocks of a text to ids: what stands before the last white space is whole, what stands after it waits."""

    LAST = regex.compile(r"(?r)\s")

    def __init__(self, encoder: Encoder):
        self.encoder, self.rest = encoder, ""
        self.stretch: _Stretch | None = None

    def push(self, text: str) -> Iterator[bytes]:
        data, self.rest = self.rest + text, ""
        if self.stretch is not None:
            m = Encoder.SPACE.search(data)
            yield from self.stretch.push(data[: m.start()] if m else data)
            if not m:
                return
            yield from self.stretch.finish()
            self.stretch, data = None, data[m.start() :]
        if m := self.LAST.search(data):
            yield self.encoder.block(data[: m.end()])
            data = data[m.end() :]
        if len(data) > LONG:
            self.stretch = _Stretch(self.encoder)
            yield from self.stretch.push(data)
        else:
            self.rest = data

    def finish(self) -> Iterator[bytes]:
        if self.stretch is not None:
            yield from self.stretch.finish()
        elif self.rest:
            yield self.encoder.block(self.rest)


class _Stretch:
    """Ids of a run of characters without white space, however long, given in parts."""

    MORE = {"letters": regex.compile(r"[\p{L}]*"), "others": regex.compile(r"[^\s\p{L}\p{N}]*")}
    EDGE = 3  # characters in which a match may still become another, as in 're

    def __init__(self, encoder: Encoder):
        self.encoder, self.machine = encoder, WordTransducer(encoder.v)
        self.raw, self.text, self.open = "", "", ""
        self.reach = max(map(len, encoder.v.special), default=1) - 1

    def push(self, data: str) -> Iterator[bytes]:
        special, self.raw = self.encoder.special, self.raw + data
        while special and (m := special.search(self.raw)):
            yield from self._normal(self.raw[: m.start()], True)
            yield array("i", [self.encoder.v.special[m[0]]]).tobytes()
            self.raw = self.raw[m.end() :]
        at = len(self.raw) - 1
        if special and (mark := self.raw.find("<", max(0, len(self.raw) - self.reach))) >= 0:  # a special token may begin here
            at = mark
        while at > 0 and not _starts_anew(self.raw[at]):
            at -= 1
        ready, self.raw = self.raw[: max(at, 0)], self.raw[max(at, 0) :]
        yield from self._normal(ready, False)

    def finish(self) -> Iterator[bytes]:
        yield from self._normal(self.raw, True)
        self.raw = ""

    def _normal(self, part: str, last: bool) -> Iterator[bytes]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        yield from self._words(part.lower(), last)

    def _words(self, part: str, last: bool) -> Iterator[bytes]:
        text, at, self.text = self.text + part, 0, ""
        if self.open:
            at = self.MORE[self.open].match(text).end()
            yield self._ids(self.machine.push(text[:at].encode("utf-8", "replace")))
            if at == len(text) and not last:
                return
            yield self._ids(self.machine.finish())
            self.open = ""
        for m in Encoder.SPLIT.finditer(text, at):
            if not last and m.end() > len(text) - self.EDGE:
                if m.end() == len(text) and m.end() - m.start() > LONG:
                    self.open = "letters" if m[0][-1].isalpha() else "others"
                    yield self._ids(self.machine.push(m[0].encode("utf-8", "replace")))
                else:
                    self.text = text[m.start() :]
                return
            yield self._ids(self.encoder._word(m[0]))

    @staticmethod
    def _ids(found: Iterable[int]) -> bytes:
        return array("i", list(found)).tobytes()


@lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process: its memo outlives a task, until the worker runs another operator."""
    return Encoder(Vocabulary(path))


keeps(__name__, encoder_of.cache_clear)


class Decoder:
    """Ids to text, incrementally: only the bytes of an unfinished character are held. A word's end becomes a space."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.token_bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


class LibraryDecoder:
    """The same machine for the library's text form: this kind of file names no decoder, so tokens are shown in their own
    letters with a space between. The state is whether a token went before."""

    def __init__(self, vocabulary: Vocabulary):
        self.table, self.begun = vocabulary.library_bytes, False

    def push(self, ids: list[int]) -> bytes:
        if not ids:
            return b""
        text = b" ".join(map(self.table.__getitem__, ids))
        text, self.begun = (b" " + text if self.begun else text), True
        return text


def bpe_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded of every whole text.

    A null text is empty: no tokens, digests of nothing. Repeated rows give repeated rows, a null doc_id stays null, an
    empty table gives no rows. Ids go to the digests and to the decoders as they become stable, so nothing but the text
    itself grows with a document. Columns of other names play no part. Every worker reads the vocabulary file at vocabulary_path, which must be there on each machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary_path)
        vocabulary = encoder.v
        decimal = vocabulary.decimal.__getitem__
        for batch in batches:
            for part in pieces(batch, 16 << 20):
                rows = []
                for raw in raw_texts(part.column(1)):
                    a, b = hashlib.sha256(), hashlib.sha256()
                    shown, text, n_chars, n_tokens = LibraryDecoder(vocabulary), Decoder(vocabulary), 0, 0
                    for ids in encoder.stream(raw):
                        some = np.frombuffer(ids, "<i4").tolist()
                        if some:
                            a.update(b" " * (n_tokens > 0) + b" ".join(map(decimal, some)))
                            b.update(shown.push(some))
                            n_chars += len(text.push(some))
                            n_tokens += len(some)
                    rows.append((n_tokens, a.hexdigest(), b.hexdigest(), n_chars + len(text.finish())))
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")


def encode_column(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text. A null text gives an empty list; repeated rows, null ids and empty
    tables as in bpe_digests()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary_path)
        for batch in batches:
            for part in pieces(batch, 8 << 20):
                found = [encoder.encode(raw.decode("utf-8", "replace")) for raw in raw_texts(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): lower-case text with a space after every word, as the vocabulary keeps no more.
    Null and empty lists give an empty text; repeated rows and null ids stay, and an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder_of(vocabulary_path).v
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                machine = Decoder(vocabulary)
                texts.append(machine.push(ids or []) + machine.finish())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return private(encoded).select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")
