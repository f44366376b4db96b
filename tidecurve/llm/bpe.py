"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens: its states are "the last token was x" and an arc x -y-> y exists if the two may
stand side by side in a correct encoding, so its paths are the correct encodings and nothing else. It is built by one
merge gadget for each merge a b -> c, in order of rank:

* the arc from a over b is taken away (for a = b also the one from a over c: leftmost pairs merge first);
* the new state c gets the outgoing arcs that b has at that moment;
* every state with an arc over a at that moment gets one over c.

Written out, that is a square of 50,000 x 50,000 arcs. It is compiled into links and exceptions instead: a copied row or
column is a link to what it was copied from and the gadget's number, and an exception is an arc that a gadget took away
(one or two for each merge). An arc is looked up along the links, whose number is bounded by the merges within two tokens.

A merge whose arc is not there when its turn comes never fires: it makes no state. Vocabularies where two merges make one token
have no such order of gadgets; their words are merged pair by pair, by rank.

A pre-split word is encoded by table-driven transitions, in one pass without search: the bytes drive an automaton of
the vocabulary (Aho and Corasick: a table from state and byte to state, and the tokens that end in each state). A prefix of the
word has one correct encoding, so it has one last token: the one among those that end there whose arc exists from the last token
of the prefix before it. The path is read back from the end. Decoding emits the arcs' labels, the tokens' bytes.

Null text counts as empty (no tokens); special tokens in a text become their id, as in the tokenizers library;
each row stands for itself, so repeated rows, ties and extra columns need no care; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-split pattern of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Arcs whose look-ups are kept.
ARCS = 1 << 19


class Automaton:
    """Links and exceptions of the token automaton, the byte automaton, and the labels."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        self.label = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}  # id: the arc's label
        self.special = special
        self.label |= {i: s.encode() for s, i in special.items()}
        size = max(self.label) + 1
        self.size = size
        self.gone: dict[int, int] = {}  # exceptions: x * size + y: the gadget that took the arc away
        self.first, self.last, self.born = [0] * size, [0] * size, [0] * size  # links: of column, of row; the gadget that made them
        for number, (a, b) in enumerate(merges, 1):
            self._gadget(number, vocab[a], vocab[b], vocab[a + b])
        self.end = len(merges) + 1
        made = [a + b for a, b in merges]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # of such vocabularies: rank and token of each pair
        if len(set(made)) < len(made):
            for rank, (a, b) in enumerate(merges):
                self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
            self.letters = {text[0]: i for i, text in self.label.items() if len(text) == 1}
        self.known: dict[int, bool] = {}  # arcs looked up, ARCS at most
        self._bytes({i: text for i, text in self.label.items() if i not in special.values() and (len(text) == 1 or self.born[i])})

    def _gadget(self, number: int, a: int, b: int, c: int) -> None:
        states = all(self.born[t] or len(self.label[t]) == 1 for t in (a, b))
        if not states or not self.arc(a, b, number):  # no correct encoding has a before b, so this merge never fires
            return
        self.gone.setdefault(a * self.size + b, number)
        if not self.born[c]:
            self.first[c], self.last[c], self.born[c] = a, b, number
            if a == b:
                self.gone.setdefault(a * self.size + c, number)

    def _bytes(self, tokens: dict[int, bytes]) -> None:
        """The byte automaton. goes: for each state a table from byte to state; ends: for each state the tokens that end there
        and their lengths, the longest first."""
        self.goes: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for i, text in tokens.items():
            at = 0
            for x in text:
                to = self.goes[at].get(x)
                if to is None:
                    to = self.goes[at][x] = len(self.goes)
                    self.goes.append({})
                    own.append(-1)
                at = to
            own[at] = i
        n = len(self.goes)
        self.fails, self.ends = [0] * n, [()] * n
        queue = list(self.goes[0].values())
        for at in queue:  # breadth first: a state's fallback is shorter, so done before
            fail = self.fails[at]
            told = self.ends[fail]
            self.ends[at] = ((own[at], len(tokens[own[at]])), *told) if own[at] >= 0 else told
            for x, to in self.goes[at].items():
                back = fail
                while back and x not in self.goes[back]:
                    back = self.fails[back]
                self.fails[to] = self.goes[back].get(x, 0) if at else 0
                queue.append(to)

    def arc(self, x: int, y: int, before: int | None = None) -> bool:
        """Whether y may follow x after all gadgets, or after those of smaller numbers: the links lead back to two bytes or to an exception."""
        gone, born, before = self.gone, self.born, before or self.end
        while True:
            if gone.get(x * self.size + y, before) < before:
                return False
            p, q = born[x], born[y]
            if not (p or q):
                return True
            if p >= q:  # c's row was copied from its last part, as it stood then; c's own column (x = y) after it
                if p == q:
                    y = self.first[y]
                before, x = p, self.last[x]
            else:
                before, y = q, self.first[y]

    def word(self, text: bytes) -> tuple[int, ...]:
        """The ids of a pre-split word: the one path of the automaton that spells it."""
        if self.pairs:
            return self._merged(text)
        goes, fails, ends, known, size = self.goes, self.fails, self.ends, self.known, self.size
        state, lasts, sizes = 0, [], []
        for at, x in enumerate(text):
            while (to := goes[state].get(x)) is None and state:
                state = fails[state]
            state = to or 0
            for token, n in ends[state]:
                if n > at:
                    break
                last = lasts[at - n]
                if (found := known.get(last * size + token)) is None:
                    if len(known) >= ARCS:
                        known.clear()
                    found = known[last * size + token] = last >= 0 and self.arc(last, token)
                if found:
                    break
            else:
                token, n = -1, 1
            lasts.append(token)
            sizes.append(n)
        path, at = [], len(text)
        while at:
            if (token := lasts[at - 1]) < 0:
                raise ValueError(f"no path spells {text!r}")
            path.append(token)
            at -= sizes[at - 1]
        return tuple(reversed(path))


    def _merged(self, text: bytes) -> tuple[int, ...]:
        """The ids by merging the pair of the lowest rank, the leftmost first."""
        ids = [self.letters[x] for x in text]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(*self.pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pairs]
        queue = [(rank, i, p, token) for rank, token, i, p in queue]
        heapq.heapify(queue)
        while queue:
            _, i, pair, token = heapq.heappop(queue)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = token, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if a >= 0 and b < n and (found := self.pairs.get((ids[a], ids[b]))):
                    heapq.heappush(queue, (found[0], a, (ids[a], ids[b]), found[1]))
        return tuple(t for t in ids if t >= 0)


def load(path: str) -> Automaton:
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in told.get("added_tokens", ()) if t.get("special")})


class Encoder:
    """Whole texts to ids and back. Words met before are kept in two generations of up to a number of them: when the
    younger is full, the older goes and words met again pass over, so frequent words stay and memory is bounded."""

    def __init__(self, automaton: Automaton, keep: int = 200_000, keep_bytes: int = 64) -> None:
        self.automaton, self.keep, self.keep_bytes = automaton, keep, keep_bytes
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True))) + ")") if automaton.special else None

    def _word(self, word: str) -> tuple[int, ...]:
        if (found := self.old.get(word)) is None:
            found = self.automaton.word(word.encode("utf-8", "replace"))
        if len(word) <= self.keep_bytes:
            if len(self.young) >= self.keep:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.cut.split(text) if self.cut and any(s in text for s in self.automaton.special) else (text,):
            if (i := self.automaton.special.get(piece)) is not None:
                ids.append(i)
                continue
            for word in self.split(piece):
                ids += self.young.get(word) or self._word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.automaton.label.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(load(path))
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of every whole text. vocabulary: path of the file, the same on all machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            ids = pa.array([tool.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of arrays of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else tool.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["key", "text"])

    named = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return named.mapInArrow(run, f"key {encoded.schema[key].dataType.simpleString()}, text string").withColumnRenamed("key", key)


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digest(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What the encoding of every whole text amounts to, and its decoding from the ids, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        shown = list(map(str, range(tool.automaton.size)))
        for batch in batches:
            n, digest, back = [], [], []
            for t in batch.column(1).to_pylist():
                ids = tool.encode(t or "")
                n.append(len(ids))
                digest.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return named.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {DIGEST}").withColumnRenamed("key", key)
