"""BPE encoding, decoding and token counts.

``encode_documents`` runs a bounded-lookahead streaming transducer over every text: words come off
the text one after another, a word's tokens are emitted as soon as no later byte can change them,
and only the bytes after the last settled token are held, in words of any length and in texts without white space. The ids go
through an incremental decoder that holds no more than the bytes of one unfinished character. ``count_tokens`` keeps, for every prefix,
the exact number of tokens (prefix dynamic programming), so truncation and budgets need no second
encoding.

Defined cases: a null text counts as empty (0 tokens, the digests of no bytes); a special token's
string inside a text is that token, as the tokenizers library has it by default; repeated rows give
repeated results; other columns are left alone (the query selects its own).
"""

from __future__ import annotations

import codecs
import hashlib
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_core import MergeTable
from .common import by_slices, clear_of
from .unicode_gap import NEW_LETTERS, NEW_NUMBERS, TO_LOWER

#: Distinct words whose answer a worker remembers, and the longest of them.
WORDS, WORD_CHARS = 300_000, 48
#: Bytes of a word that the transducer is fed at a time.
FEED = 2048
#: A text is split into words in runs of about so many characters, cut at white space if there is some, else anywhere.
RUN_CHARS = 1 << 16
#: Characters after a word that can change where it ends: those of the longest contraction.
AHEAD = 3

SPACE = r"\p{White_Space}"


def _splitters(letter: str, number: str) -> tuple[regex.Pattern, regex.Pattern]:
    """The split patterns of the word-end and of the byte-level vocabularies."""
    other = rf"(?:(?!{letter}|{number})\P{{White_Space}})" if "(?!" in letter else rf"[^{SPACE}\p{{L}}\p{{N}}]"
    word = rf"'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|{other}+"
    piece = rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|{SPACE}+(?!\P{{White_Space}})|{SPACE}+"
    return regex.compile(word), regex.compile(piece)


_WORD, _PIECE = _splitters(r"\p{L}", r"\p{N}")
# for the rare text with characters that are newer than the library's tables
_NEW = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]")
_NEW_WORD, _NEW_PIECE = _splitters(rf"(?:(?![{NEW_LETTERS}])\p{{L}})", rf"(?:(?![{NEW_NUMBERS}])\p{{N}})")
_GAP, _EDGE = regex.compile(SPACE), regex.compile(rf"\P{{White_Space}}(?={SPACE})")


def _kinds(letter: str, number: str) -> tuple[regex.Pattern, ...]:
    other = rf"(?:(?!{letter}|{number})\P{{White_Space}})"
    return regex.compile(letter), regex.compile(f"(?:{letter})*"), regex.compile(f"{other}*")


_LETTER, _LETTERS, _OTHERS = _kinds(r"\p{L}", r"\p{N}")
_NEW_LETTER, _NEW_LETTERS, _NEW_OTHERS = _kinds(rf"(?:(?![{NEW_LETTERS}])\p{{L}})", rf"(?:(?![{NEW_NUMBERS}])\p{{N}})")


def is_new(text: str) -> bool:
    return not text.isascii() and max(text) >= NEW_LETTERS[0] and _NEW.search(text) is not None


@lru_cache(maxsize=4)
def merge_table(path: str) -> MergeTable:
    """One table per worker and file; workers outlive tasks."""
    return MergeTable(path)


class Memo(dict):
    """Remembers answers for short words. When half the limit is reached they become the older half, and what was older
    and not asked for since is forgotten."""

    def __init__(self, answer, limit: int = WORDS):
        self.answer, self.half, self.older = answer, limit // 2, {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is None:
            value = self.answer(word)
        if len(word) <= WORD_CHARS:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = value
        return value


class WordTransducer:
    """Bytes of one word in, tokens out, each as soon as it is stable.

    ``feed`` takes the next bytes; tokens that end at least ``lookahead`` bytes before the
    newest byte are final and returned. ``close`` ends the word. What is held is bounded by the
    lookahead, the longest token and the size of one feed, however long the word is."""

    def __init__(self, merges: MergeTable, lookahead: int):
        self.m, self.lookahead = merges, lookahead
        self.start()

    def start(self) -> None:
        """Ready for another word."""
        self.base, self.settled = 0, 0  # byte where the window begins; byte up to which tokens are out
        self.data, self.last = b"", []

    def feed(self, chunk: bytes) -> list[int]:
        self.data += chunk
        # the newest byte may yet turn out to be the word's last, with another symbol
        self.m.extend(self.last, self.data[:-1], self.base, False)
        return self._emit(self.base + len(self.last) - self.lookahead)

    def close(self, chunk: bytes = b"") -> list[int]:
        self.data += chunk
        self.m.extend(self.last, self.data, self.base, True)
        return self._emit(self.base + len(self.last), True)

    def word(self, raw: bytes) -> list[int]:
        """A whole word, fed piece by piece."""
        if len(raw) <= FEED:  # fed at once, so nothing to settle
            return self.m.encode_word(raw)
        self.start()
        out = []
        for at in range(0, len(raw) - FEED, FEED):
            out += self.feed(raw[at : at + FEED])
        return out + self.close(raw[(len(raw) - 1) // FEED * FEED :])

    def _emit(self, limit: int, end: bool = False) -> list[int]:
        if limit <= self.settled:
            return []
        path, at = [], self.base + len(self.last)
        while at > self.settled:
            token = self.last[at - 1 - self.base]
            path.append((at, token))
            at -= self.m.length[token]
        out = [t for upto, t in reversed(path) if upto <= limit]
        if out:
            self.settled += sum(self.m.length[t] for t in out)
        drop = self.settled - self.m.longest - self.base
        if drop > 0 and not end:
            self.data, self.last, self.base = self.data[drop:], self.last[drop:], self.base + drop
        return out


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that a normal form may join to those before them."""
    later = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, range(0x80, 0x110000)):
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c) or parts and parts[0] != "<" and unicodedata.combining(chr(int(parts.split()[0], 16))):
            later.add(c)
        if parts and parts[0] != "<":
            later.update(chr(int(p, 16)) for p in parts.split()[1:])
    return frozenset(later)


class LongWord:
    """A word that is longer than a run: what it has in common is a kind of character, so each run says how far it goes on."""

    def __init__(self, merges: MergeTable, lookahead: int, begin: str):
        self.t, self.begin = WordTransducer(merges, lookahead), begin
        new = _NEW_LETTER if is_new(begin) else _LETTER
        self.letters = new.match(begin) is not None

    def more(self, run: str) -> int:
        letters, others = (_NEW_LETTERS, _NEW_OTHERS) if is_new(run) else (_LETTERS, _OTHERS)
        return (letters if self.letters else others).match(run).end()

    def _pieces(self, run: str) -> Iterator[bytes]:
        run, self.begin = self.begin + run, ""
        for at in range(0, len(run), FEED):
            yield run[at : at + FEED].encode("utf-8", "surrogatepass")

    def feed(self, run: str) -> bytes:
        return b"".join(array("I", self.t.feed(p)).tobytes() for p in self._pieces(run))

    def close(self, run: str) -> bytes:
        return self.feed(run) + array("I", self.t.close()).tobytes()


class Transducer:
    """Text to tokens for word-end vocabularies: normal form, words, tokens, in runs of bounded size."""

    def __init__(self, path: str, run_chars: int = RUN_CHARS):
        self.m = merge_table(path)
        self.lookahead = self.m.lookahead()
        self.run_chars = run_chars
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) or r"(?!)")
        self.words = WordTransducer(self.m, self.lookahead)
        self.memo = Memo(lambda w: array("I", self.words.word(w.encode("utf-8", "surrogatepass"))).tobytes())

    def runs(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in runs, and whether each ends before white space or with the text, so that no word goes on in the next one. Where
        there is no white space for long, runs end before a character that no normal form joins to what is before it."""
        at, n = 0, len(text)
        while n - at > self.run_chars:
            gap = _GAP.search(text, at + self.run_chars, at + 2 * self.run_chars)
            if gap:
                yield text[at : gap.start()], True
                at = gap.start()
                continue
            end = at + self.run_chars
            while end < n and text[end] in joining():
                end += 1
            if end == n:
                break
            yield text[at:end], False
            at = end
        yield (text[at:] if at else text), True

    def normal(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            # letter by letter: no final sigma
            text = text.replace("Σ", "σ").lower()
            return text.translate(TO_LOWER) if max(text) > "\u1c88" else text
        return text.lower()

    def stream(self, text: str) -> Iterator[bytes]:
        """Packed ids (little-endian, 32 bits), run by run."""
        get = self.memo.__getitem__
        for part in self.split(text):
            if part in self.m.special:
                yield array("I", [self.m.special[part]]).tobytes()
                continue
            left, open_ = "", None  # characters whose words may go on, and a long word under way
            for run, whole in self.runs(part):
                run = left + self.normal(run) if left else self.normal(run)
                left, out = "", []
                pattern = _NEW_WORD if is_new(run) else _WORD
                if open_ is not None:
                    more = open_.more(run)
                    if more == len(run) and not whole:
                        yield open_.feed(run)
                        continue
                    out.append(open_.close(run[:more]))
                    open_, run = None, run[more:]
                if whole:
                    out += map(get, pattern.findall(run))
                else:
                    sure = len(run) - AHEAD
                    for m in pattern.finditer(run):
                        if m.end() > sure:
                            left = run[m.start() :]
                            break
                        out.append(get(m.group()))
                    if len(left) > self.run_chars // 2 and (m.end() == len(run)):
                        open_ = LongWord(self.m, self.lookahead, left)
                        left = ""
                        out.append(open_.feed(""))
                yield b"".join(out)

    def split(self, text: str) -> Iterator[str]:
        at = 0
        if "<|" in text:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()]
                yield m.group()
                at = m.end()
        if at < len(text):
            yield text[at:] if at else text


class Decoder:
    """Ids to text, a state machine over bytes: ids in any pieces, characters out as soon as their last byte is in.

    A vocabulary file without a decoder has the library put the tokens' strings side by side with blanks (``feed``). The bytes that
    tokens stand for, with a blank at each word's end, are what ``readable`` gives. Held is an unfinished character."""

    def __init__(self, merges: MergeTable):
        self.m, self.first = merges, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        said = b" ".join(map(self.m.said.__getitem__, ids))
        if said and not self.first:
            said = b" " + said
        self.first = self.first and not said
        return self.utf8.decode(said)

    def readable(self, ids: Iterable[int], final: bool = False) -> str:
        return self.utf8.decode(b"".join(map(self.m.bytes.__getitem__, ids)), final)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = False, row: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per document, with ``keep_ids`` the ids and the decoded text themselves,
    with ``row`` the row's place in the table. Row-local: no shuffle, memory beside the text bounded by a run of it."""

    def encode(part: pa.RecordBatch) -> dict[str, object]:
        t = transducer(path)
        cols: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
        for text in part.column("text").to_pylist():
            ids_hash, text_hash, n, decoder = hashlib.sha256(), hashlib.sha256(), 0, Decoder(t.m)
            kept, said = array("I"), []
            for packed in t.stream(text or ""):
                ids = array("I", packed)
                ids_hash.update(packed)
                n += len(ids)
                words = decoder.feed(ids)
                text_hash.update(words.encode("utf-8", "surrogatepass"))
                if keep_ids:
                    kept.extend(ids)
                    said.append(words)
            cols["n_tokens"].append(n)
            cols["ids_sha256"].append(ids_hash.hexdigest())
            cols["decoded_sha256"].append(text_hash.hexdigest())
            if keep_ids:
                cols["ids"].append(list(kept))
                cols["decoded"].append("".join(said))
        return {"doc_id": part.column("doc_id"), "_row": part.column("_row") if row else None, **cols}

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<long>, decoded string"
    place = [F.monotonically_increasing_id().alias("_row")] if row else []
    done = by_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place), encode, schema + ", _row long" * bool(row))
    return done.withColumnRenamed("_row", row) if row else done


class Counter:
    """Exact token counts at every prefix of a text, for byte-level vocabularies."""

    def __init__(self, path: str):
        self.m = merge_table(path)
        if self.m.suffix:
            raise ValueError("prefix counts are for vocabularies without word ends")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.special, key=len, reverse=True))) or r"(?!)")
        # a count is a small integer, so twice as many words fit as with their ids
        self.totals = Memo(lambda w: 1 if w.encode("utf-8", "surrogatepass") in self.m.inner else self.piece(w)[-1], 2 * WORDS)

    def piece(self, piece: str) -> list[int]:
        return self.m.prefix_counts(piece.encode("utf-8", "surrogatepass"))

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        if "<|" in text:
            for m in self.special.finditer(text):
                if m.start() > at:
                    yield text[at : m.start()], False
                yield m.group(), True
                at = m.end()
        if at < len(text):
            yield text[at:], False

    def runs(self, text: str) -> Iterator[str]:
        """The text in runs that end before white space that follows something else, where a piece always ends."""
        at = 0
        while len(text) - at > RUN_CHARS:
            gap = _EDGE.search(text, at + RUN_CHARS)
            if not gap:
                break
            yield text[at : gap.start() + 1]
            at = gap.start() + 1
        yield text[at:] if at else text

    def count(self, text: str) -> int:
        total, get = 0, self.totals.__getitem__
        for part, special in self.parts(text):
            if special:
                total += 1
                continue
            for run in self.runs(part):
                pieces = _NEW_PIECE if is_new(run) else _PIECE
                total += sum(map(get, pieces.findall(run) if len(run) <= 2 * RUN_CHARS else (m.group() for m in pieces.finditer(run))))
        return total

    def prefixes(self, text: str) -> array:
        """Entry ``i``: the number of tokens of ``text[:i]``, as if it were encoded alone.

        A piece boundary at ``p`` stands in every prefix longer than ``p``, so a prefix costs what
        came before its last boundary and what the program has for the part of a piece after it.
        White space ahead of a word, contractions and special tokens are the pieces whose
        beginnings split otherwise; those few are looked at again."""
        out = array("q", [0])
        done = 0  # tokens before the current piece
        anchor, before = 0, 0  # last boundary that stands whatever follows, and tokens before it
        at = 0
        for part, special in self.parts(text):
            if special:
                for i in range(at + 1, at + len(part)):
                    out.append(before + self.count(text[anchor:i]))
                at += len(part)
                done += 1
                out.append(done)
                anchor, before = at, done
                continue
            space = -1  # where the run of white space began, and tokens before it
            lead = 0
            for m in (_NEW_PIECE if is_new(part) else _PIECE).finditer(part):
                piece, start = m.group(), at + m.start()
                if _GAP.match(piece[0]) and space < 0:
                    space, lead = start, done
                counts = self._by_char(piece)
                first = 1
                while space >= 0 and first <= len(piece) and _GAP.match(piece[first - 1]):
                    run = text[space : start + first]
                    out.append(lead + self.totals[run])
                    first += 1
                if first <= len(piece):
                    space = -1
                plain = piece[0] != "'" or len(piece) == 1 or not piece[1].isalpha()
                for k in range(first, len(piece) + 1):
                    out.append(done + (counts[k - 1] if plain or k == len(piece) else self.count(piece[:k])))
                anchor, before = (start, done) if space < 0 else (space, lead)
                done += counts[-1]
            at += len(part)
        return out

    def _by_char(self, piece: str) -> list[int]:
        counts = self.piece(piece)
        if piece.isascii():
            return counts
        at, out = -1, []
        for c in piece:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(counts[at])
        return out

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix that costs at most ``budget`` tokens. Counts may fall again as a
        prefix grows, so it is the last that fits, not the first that doesn't."""
        counts = self.prefixes(text)
        return text[: max(i for i, n in enumerate(counts) if n <= budget)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit per document. Row-local."""

    def count(part: pa.RecordBatch) -> dict[str, object]:
        c = counter(path)
        texts = [t or "" for t in part.column("text").to_pylist()]
        tokens = [c.count(t) for t in texts]
        return {
            "doc_id": part.column("doc_id"),
            "n_bytes": [len(t) if t.isascii() else len(t.encode()) for t in texts],
            "n_tokens": tokens,
            "over_limit": [n > limit for n in tokens],
        }

    return by_slices(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )


def fit_to_budget(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """The columns of ``docs`` with ``text`` cut to its longest prefix within ``budget`` tokens, and
    ``budget_tokens``, that prefix's count; null stays null with 0 tokens."""
    docs = clear_of(docs, "budget_tokens")

    def cut(batches):
        c = counter(path)
        for batch in batches:
            texts, counts = [], []
            for t in batch.column("text").to_pylist():
                kept = None if t is None else c.truncate(t, budget)
                texts.append(kept)
                counts.append(c.count(kept or ""))
            cols = {n: batch.column(n) for n in batch.schema.names} | {"text": pa.array(texts, pa.string()), "budget_tokens": pa.array(counts, pa.int64())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", budget_tokens long"
    return docs.mapInArrow(cut, schema)
