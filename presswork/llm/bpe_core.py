"""The merge list as a table: which token ends each prefix, and which pairs may stand together.

A BPE encoding is fixed by its merge list. Two facts make it incremental:

* a token sequence is the encoding of its text exactly if every neighbouring pair is, on its own,
  the encoding of the pair's text; and
* each prefix of a text has one encoding, so "the last token of the prefix" is a function.

So the encodings of all prefixes form a tree, found left to right: for each end position try the
tokens that end there, longest first, and take the one that may follow the last token of the prefix
before it. Nothing is encoded twice and the work is linear in the text for a given vocabulary.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Pairs whose answer is remembered.
PAIRS = 300_000


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies, inverted."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(spare)}


class MergeTable:
    """Vocabulary and merges of a ``tokenizers`` JSON file.

    ``suffix`` is the mark of a word's end (empty: none). Symbols are bytes; the last byte of a
    word carries the mark where there is one. Ids must ascend in the order of the merges, bytes first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        size = max(vocab.values()) + 1
        self.strings: list[str] = [""] * max(size, 1 + max(self.special.values(), default=0))
        for s, i in vocab.items():
            self.strings[i] = s
        for s, i in self.special.items():
            self.strings[i] = s
        self.left, self.right = list(range(size)), list(range(size))
        self.joined: dict[int, int] = {}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            if k <= max(i, j):
                raise ValueError("ids must ascend in the order of the merges")
            self.joined.setdefault(i << 20 | j, k)
            self.left[k], self.right[k] = i, j
        letters = byte_alphabet()
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.length = [0] * size
        for s, i in vocab.items():
            ends = bool(self.suffix) and s.endswith(self.suffix)
            core = s[: -len(self.suffix)] if ends else s
            raw = bytes(letters[c] for c in core)
            (self.final if ends else self.inner)[raw] = i
            self.length[i] = len(raw)
        #: What a token's string is in UTF-8, and what it stands for: bytes, a blank after a word's end, a special token's own name.
        self.said = [s.encode("utf-8", "surrogatepass") for s in self.strings]
        self.bytes = list(self.said)
        for raws, gap in ((self.inner, b""), (self.final, b" ")):
            for raw, i in raws.items():
                self.bytes[i] = raw + gap
        self._pairs: dict[int, bool] = {}
        self._wholes: dict[int, bool] = {}
        # a token that its own text doesn't encode to never occurs
        self.inner = {k: t for k, t in self.inner.items() if self.whole(t)}
        self.final = {k: t for k, t in self.final.items() if self.whole(t)} if self.suffix else self.inner
        self.longest = max(self.length)
        self._automaton()

    def _automaton(self) -> None:
        """The tokens that end at a byte, longest first, are those of a state: the longest beginning of a token that ends there.
        States are the nodes of a trie, and one that has no edge for a byte takes that of its longest own end."""
        edges: dict[int, int] = {}  # (state, byte) to state
        parent, byte, mine, marked = [0], [0], [0], [0]  # a token and one, so that 0 is none
        for raws, own in ((self.inner, mine), (self.final, marked)):
            for raw, token in raws.items():
                state = 0
                for c in raw:
                    to = edges.get(state << 8 | c)
                    if to is None:
                        to = edges[state << 8 | c] = len(parent)
                        parent.append(state), byte.append(c), mine.append(0), marked.append(0)
                    state = to
                own[state] = token + 1
        size = len(parent)
        self._fail, self._go, self._most = [0] * size, edges, len(edges) + PAIRS
        #: By state, (token, its bytes) inside a word, and of those that carry the mark at its end.
        self._ends: list[tuple] = [()] * size
        self._marked: list[tuple] = [()] * size
        depth = [0] * size
        for state in range(1, size):
            depth[state] = depth[parent[state]] + 1
        for state in sorted(range(1, size), key=depth.__getitem__):
            at, c = parent[state], byte[state]
            if at:
                fail = self._fail[at]
                while (to := edges.get(fail << 8 | c)) is None and fail:
                    fail = self._fail[fail]
                self._fail[state] = to or 0
            for ends, own in ((self._ends, mine), (self._marked, marked)):
                ends[state] = ends[self._fail[state]]
                if own[state]:
                    ends[state] = ((own[state] - 1, depth[state]), *ends[state])

    def _step(self, state: int, c: int) -> int:
        """The state after one without an edge for the byte."""
        fail = state
        while (to := self._go.get(fail << 8 | c)) is None and fail:
            fail = self._fail[fail]
        to = to or 0
        if len(self._go) < self._most:
            self._go[state << 8 | c] = to
        return to

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` and ``b`` together encodes as just ``a, b``.

        The merges inside both tokens are undone from the latest to the earliest; at each moment the
        two symbols that touch at the seam must have no merge that would have come first."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._seam_holds(a, b, 1 << 30)
        return known

    def _seam_holds(self, x: int, y: int, first: int) -> bool:
        """Undo merges on both sides of a seam, later ones first; false once a merge across the seam
        would have come before the one undone last (``first``)."""
        joined, left, right = self.joined, self.left, self.right
        while True:
            across = joined.get(x << 20 | y)
            if across is not None and across < first:
                return False
            # of two equal tokens the left one was made first, so the right one comes apart first
            if x > y and right[x] != x:
                first, x = x, right[x]
            elif left[y] != y:
                first, y = y + 1, left[y]
            elif right[x] != x:
                first, x = x, right[x]
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token's own text encodes as just that token."""
        known = self._wholes.get(token)
        if known is None:
            a, b = self.left[token], self.right[token]
            known = a == token or (self.whole(a) and self.whole(b) and self._seam_holds(a, b, token))
            self._wholes[token] = known
        return known

    def ends(self, word: bytes) -> list[int]:
        """The last token of every prefix: entry ``i`` for the first ``i + 1`` bytes, where only the
        whole word's last symbol carries the end mark."""
        last: list[int] = []
        self.extend(last, word, 0, True)
        return last

    def extend(self, last: list[int], data: bytes, base: int, closed: bool) -> None:
        """Add the last tokens of the prefixes that end in ``data`` beyond ``last``. ``data[0]`` is
        byte ``base`` of the word and ``last[0]`` belongs to it; of what came before, at least
        ``longest`` bytes are kept, so no token can begin there."""
        known, go, ends, longest = self._pairs, self._go, self._ends, self.longest
        at, stop, state = len(last), len(data), 0
        for c in data[max(0, at - longest) : at]:
            to = go.get(state << 8 | c)
            state = self._step(state, c) if to is None else to
        for end in range(at + 1, stop + 1):
            c = data[end - 1]
            to = go.get(state << 8 | c)
            state = self._step(state, c) if to is None else to
            if closed and end == stop and self.suffix:
                ends = self._marked
            for token, n in ends[state]:
                if n == end:
                    if not base:
                        break
                    continue
                fits = known.get(last[end - n - 1] << 20 | token)
                if fits is None:
                    fits = self.may_follow(last[end - n - 1], token)
                if fits:
                    break
            else:
                token = -1
            last.append(token)

    def encode_word(self, word: bytes) -> list[int]:
        if not word:
            return []
        whole = self.final.get(word)
        if whole is not None:
            return [whole]
        last = self.ends(word)
        out, at = [], len(word)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def prefix_counts(self, word: bytes) -> list[int]:
        """Token count of every prefix of a word without end mark: entry ``i`` for ``i + 1`` bytes."""
        counts: list[int] = []
        for end, token in enumerate(self.ends(word)):
            start = end + 1 - self.length[token]
            counts.append(1 + (counts[start - 1] if start else 0))
        return counts

    def lookahead(self) -> int:
        """Bytes beyond a token's end after which nothing to the right can change it.

        A merge ``(u, v)`` is undone by what follows only if an earlier merge takes a right-edge
        constituent ``x`` of ``v`` together with a ``y`` after it, and that one only by a still
        earlier merge at the right edge of ``y``, and so on: ranks fall strictly along the chain.
        The longest such chain, in bytes, is found in one pass in merge order, as the chains that
        begin with each left symbol are kept while ranks ascend."""
        best = [0] * len(self.left)  # longest reach of merges so far whose left symbol is x
        reach = 0
        for token in range(len(self.left)):
            if self.left[token] == token:
                continue
            u, v = self.left[token], self.right[token]
            far, x = 0, v
            while True:
                far = max(far, best[x])
                if self.right[x] == x:
                    break
                x = self.right[x]
            reach = max(reach, far)
            best[u] = max(best[u], self.length[v] + far)
        return max([reach, *best]) + self.longest
