"""Token counts by a compiled finite-state transducer.

The vocabulary of a byte-fallback BPE model is compiled into a deterministic transducer over characters. A state
holds, for each place at which a piece may still be open, the last token before it, how many tokens fewer there are
up to it, and the trie node of what was read since. A transition carries the number of tokens that reading the
character adds (it may be negative, when pieces merge). This rests on a property of BPE: a sequence of pieces is the
encoding of its text exactly if every two neighbours are the encoding of their joined text, so each prefix has one
last token and a bounded look back finds it. States are made when first reached and kept in a bounded table.

Spaces separate texts into segments that no piece crosses, and so do characters outside the vocabulary's alphabet. A
chunk of a text is therefore a map from the state in which it is entered to the state in which it is left: what stands
before its first boundary (its head) depends on the entry, all that follows is the same for every entry. Maps compose
by reading the second's head in the first's last state; of a head without boundaries only the beginning is read again,
as the states soon agree with those of an entry at a boundary. Long texts are cut into chunks that are rows of their own:
the maps are made in parallel, blocks of maps are composed in parallel, and the blocks' maps in turn, level by level.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import cut, small_batches

SPACE = "\u2581"
CHUNK = 1 << 20
MOST_STATES = 250_000
MOST_WORDS = 300_000
LONG_SEGMENT = 64
AGREE = 512  # characters within which the states after two entries are expected to agree

_compiled: dict[str, Transducer] = {}


class Pieces:
    """What the transducer is compiled from: the ordinary pieces and their merge scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not special(i)}
        if bad := next((p for p in self.score if SPACE in p.lstrip(SPACE)), None):
            raise ValueError(f"a piece crosses a space: {bad!r}")
        if sp.encode("") or sp.encode("a  b") == sp.encode("a b"):
            raise ValueError("the model changes white space")
        if not sp.encode_as_pieces("a")[0].startswith(SPACE):
            raise ValueError("the model adds no space before a text")

    def merge(self, text: str) -> list[str]:
        """Plain BPE: join the neighbours of highest score, leftmost first, until none can be joined."""
        parts = list(text)
        while len(parts) > 1:
            joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
            best = max(((self.score[t], -i) for i, t in enumerate(joined) if t in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            parts[i : i + 2] = [joined[i]]
        return parts


class State(NamedTuple):
    """Where reading stands: spaces that precede the open word, its places (of ``Transducer.open``), tokens so far in it."""

    blank: int
    places: tuple
    n: int


class Map(NamedTuple):
    """What a chunk does to the state in which it is entered.

    head: what stands before the first boundary; at_once: the state after the head if the chunk is entered at a boundary,
    where the head is long; closed: tokens from the first boundary on up to the open word, None without a boundary; last:
    the state at the end, None without a boundary.
    """

    head: str
    at_once: State | None
    closed: int | None
    last: State | None


class Transducer:
    """Counts tokens of segments: ``▁`` and what follows it up to the next one, without characters of other alphabets."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        score = self.pieces.score
        self.alphabet = {c for p in score for c in p}
        self.outside = re.compile("[^" + "".join(re.escape(c) for c in sorted(self.alphabet)) + "]")
        # The trie of pieces: a node is a number; token 0 stands for the start of a segment.
        self.child: list[dict[str, int]] = [{}]
        self.token_at: list[int] = [-1]
        self.text: list[str] = [""]
        self.id_of: dict[str, int] = {}
        for p in sorted(score):
            if set(p) == {SPACE} and len(p) > 1:
                continue  # runs of spaces are counted by run()
            self._insert(p)
        for c in sorted(self.alphabet - set(self.id_of)):
            self._insert(c)  # a character that is no piece itself: bytes, as many as it has
        self.cost = [1 if t in score else len(t.encode()) for t in self.text]
        self.fits: dict[tuple[int, int], bool] = {}
        self.real: dict[int, bool] = {}
        self.runs: dict[int, int] = {0: 0}
        self.period = self._period()
        self._clear()

    def _insert(self, piece: str) -> None:
        node = 0
        for c in piece:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.token_at.append(-1)
            node = self.child[node][c]
        self.token_at[node] = self.id_of[piece] = len(self.text)
        self.text.append(piece)

    def _clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.open: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.words: tuple[Words, Words] = (Words(self, ""), Words(self, SPACE))
        self.start = self._state(((0, 0, 0, False),))

    def _state(self, key: tuple) -> int:
        n = self.states.get(key)
        if n is None:
            n = self.states[key] = len(self.open)
            self.open.append(key)
            self.next.append({})
        return n

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a."""
        if a == 0:
            if b not in self.real:
                self.real[b] = len(self.pieces.merge(self.text[b])) == 1
            return self.real[b]
        k = (a, b)
        if k not in self.fits:
            if len(self.fits) > MOST_STATES:
                self.fits.clear()
            self.fits[k] = self.pieces.merge(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return self.fits[k]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """The transition: next state and tokens emitted."""
        places = []
        for last, fewer, node, alone in self.open[state]:
            nxt = self.child[node].get(c)
            if nxt is not None:
                places.append((last, fewer, nxt, alone))
        for last, fewer, node, alone in places:
            token = self.token_at[node]
            if token >= 0 and self._fit(0, token) and (not last or self._fit(last, token)):
                gained = self.cost[token] - fewer
                lone = alone if last else self.text[token] == SPACE
                break
        else:
            raise ValueError(f"no last token before {c!r}")
        live = [(lt, f + gained, n, al) for lt, f, n, al in places if self.child[n]]
        live.append((token, 0, 0, lone))
        out = self._state(tuple(live)), gained
        self.next[state][c] = out
        return out

    def segment(self, text: str) -> tuple[int, bool]:
        """Tokens of a segment, and whether its first token is a single ``▁``."""
        state, n = self.start, 0
        for c in text:
            hit = self.next[state].get(c)
            state, gained = hit or self.step(state, c)
            n += gained
        lone = bool(text) and self.open[state][-1][3]
        if len(self.open) > MOST_STATES:
            self._clear()
        return n, lone

    def _piled(self, parts: Iterable[int]) -> list[int]:
        """Runs of spaces joined as BPE does: all have one score, so the leftmost pair that is a piece joins first."""
        pile: list[int] = []
        for p in parts:
            pile.append(p)
            while len(pile) > 1 and SPACE * (pile[-2] + pile[-1]) in self.pieces.score:
                pile[-2:] = [pile[-2] + pile[-1]]
        return pile

    def run(self, k: int) -> int:
        """Tokens of k spaces that no word takes part of.

        Once the spaces read so far are one piece that no longer one begins with, what follows is a run of its own.
        """
        if k not in self.runs:
            if self.period and k > self.period:
                return k // self.period + self.run(k % self.period)
            if len(self.runs) > 10_000:
                self.runs.clear()
                self.runs[0] = 0
            self.runs[k] = len(self._piled([1] * k))
        return self.runs[k]

    def _period(self) -> int:
        """The longest piece of spaces, if as many spaces join to it and to nothing longer; else 0."""
        longest = max((len(p) for p in self.pieces.score if set(p) == {SPACE}), default=0)
        return longest if longest and self._piled([1] * longest) == [longest] else 0

    def line(self, text: str, spaced: bool) -> int:
        """Tokens of a text within the alphabet; spaced: a ``▁`` stands before it."""
        plain, after = self.words
        parts = text.split(SPACE)
        n = 0
        if not spaced:
            n = plain[parts[0]] if parts[0] else 0
            parts = parts[1:]
        if "" not in parts:
            return n + sum(map(after.__getitem__, parts))
        blank = 0
        for p in parts:
            blank += 1
            if p:
                n += after[p] if blank == 1 else self._spaced(p, blank)
                blank = 0
        return n + self.run(blank)

    def _spaced(self, word: str, blank: int) -> int:
        n, lone = self.segment(SPACE + word)
        return n - 1 + self.run(blank) if lone else n + self.run(blank - 1)

    def inside(self, text: str, spaced: bool) -> int:
        """Tokens of a whole text; a character outside the alphabet is as many tokens as it has bytes."""
        n = at = 0
        for m in self.outside.finditer(text):
            n += self.line(text[at : m.start()], spaced) + len(m[0].encode())
            at, spaced = m.end(), False
        return n + self.line(text[at:], spaced)

    # --- chunks of long texts -----------------------------------------------------------------------------------------

    def opened(self, spaced: bool) -> State:
        """The state at a text's start, or after a character outside the alphabet."""
        return State(1 if spaced else 0, self.open[self.start] if not spaced else (), 0)

    def _closed(self, s: State) -> int:
        """Tokens of the open word with the spaces before it."""
        if not s.places:
            return self.run(s.blank)
        if s.blank <= 1:
            return s.n
        return s.n - 1 + self.run(s.blank) if s.places[-1][3] else s.n + self.run(s.blank - 1)

    def _word(self, s: State, text: str) -> State:
        """Characters of a word read in a state."""
        if not text:
            return s
        n, state = s.n, self._state(s.places or self.open[self.start])
        if not s.places:
            text = SPACE + text  # the last of the spaces belongs to the word
        for c in text:
            hit = self.next[state].get(c)
            state, gained = hit or self.step(state, c)
            n += gained
        out = State(s.blank, self.open[state], n)
        if len(self.open) > MOST_STATES:
            self._clear()
        return out

    def feed(self, s: State, text: str) -> tuple[int, State]:
        """Read a text in a state: the tokens that are closed by it, and the state at its end."""
        closed = at = 0
        for m in self.outside.finditer(text):
            n, s = self._feed(s, text[at : m.start()])
            closed += n + self._closed(s) + len(m[0].encode())
            at, s = m.end(), self.opened(False)
        n, s = self._feed(s, text[at:])
        return closed + n, s

    def _feed(self, s: State, text: str) -> tuple[int, State]:
        """The same for a text within the alphabet."""
        first = text.find(SPACE)
        if first < 0:
            return 0, self._word(s, text)
        last = text.rfind(SPACE)
        s = self._word(s, text[:first])
        closed = 0
        if s.places and s.places != self.open[self.start]:
            closed, s = self._closed(s), State(0, (), 0)
        elif s.places:  # nothing read since the start of an unspaced text
            s = State(0, (), 0)
        if last > first and text[first + 1 : last].strip(SPACE):  # words in between, closed by a space
            lead = len(text[first:last]) - len(text[first:last].lstrip(SPACE))
            inner = text[first + lead : last].rstrip(SPACE)
            gap = last - first - lead - len(inner)
            word, _, rest = inner.partition(SPACE)
            opened = self._word(State(s.blank + lead, (), 0), word)
            closed += self._closed(opened)
            if rest or inner.endswith(SPACE):
                closed += self.line(SPACE + rest, False)
            s = State(gap + 1, (), 0)
        else:
            s = State(s.blank + last - first + 1, (), 0)
        return closed, self._word(s, text[last + 1 :])

    def map_of(self, text: str) -> Map:
        """The map of a chunk.

        A boundary is a character outside the alphabet, or a space after another character; the chunk's own first
        character is none, as what stands before it isn't known.
        """
        at = re.search(f"(?<=[^{SPACE}]){SPACE}", text)
        out = self.outside.search(text)
        if out and (not at or out.start() < at.start()):
            head, rest, n, s = text[: out.start()], text[out.end() :], len(out[0].encode()), self.opened(False)
        elif at:
            head, rest, n, s = text[: at.start()], text[at.start() :], 0, State(0, (), 0)
        else:
            return Map(text, self._at_once(text), None, None)
        closed, last = self.feed(s, rest)
        return Map(head, self._at_once(head), n + closed, last)

    def _at_once(self, head: str) -> State | None:
        return self._word(State(1, (), 0), head) if len(head) > AGREE and SPACE not in head else None

    def _after(self, s: State, m: Map) -> tuple[int, State]:
        """A map's head read in a state. The states after it and after an entry at a boundary are read side by side until
        they agree; from there on the map knows the rest."""
        if m.at_once is None or not (s.places or s.blank):
            return self.feed(s, m.head)
        a, b = s, State(1, (), 0)
        for i in range(0, AGREE, 32):
            part = m.head[i : i + 32]
            a, b = self._word(a, part), self._word(b, part)
            bare = lambda x: [p[:3] for p in x.places]
            if bare(a) == bare(b) and len({p[3] for p in a.places}) == 1 and len({p[3] for p in m.at_once.places}) == 1:
                lone = a.places[0][3]
                places = tuple((*p[:3], lone) for p in m.at_once.places)
                if a.places[0][0] and m.at_once.places[0][0]:
                    return 0, State(a.blank, places, a.n + m.at_once.n - b.n)
        return self.feed(s, m.head)

    def applied(self, s: State, m: Map) -> tuple[int, State]:
        """Enter a chunk in a state: the tokens that are closed by it, and the state in which it is left."""
        closed, after = self._after(s, m)
        if m.closed is None:
            return closed, after
        if after.places != self.open[self.start]:  # else nothing is open
            closed += self._closed(after)
        return closed + m.closed, m.last

    def joined(self, a: Map, b: Map) -> Map:
        """The map of two chunks, one after the other; associative."""
        if a.closed is None:
            if b.closed is None:
                if a.at_once and SPACE not in b.head:
                    return Map(a.head + b.head, self._after(a.at_once, b)[1], None, None)
                return self.map_of(a.head + b.head)
            both = self.map_of(a.head + b.head)
            if both.closed is None:
                return Map(both.head, both.at_once, b.closed, b.last)
            n, _ = both.closed, both.last
            if both.last.places != self.open[self.start]:
                n += self._closed(both.last)
            return Map(both.head, both.at_once, n + b.closed, b.last)
        n, last = self.applied(a.last, b)
        return Map(a.head, a.at_once, a.closed + n, last)

    def total(self, maps: Iterable[Map]) -> int:
        """Tokens of a text, from its chunks' maps in order."""
        n, s = 0, self.opened(True)
        for m in maps:
            more, s = self.applied(s, m)
            n += more
        return n + (self._closed(s) if s.places != self.open[self.start] else 0)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        if len(text) <= chunk:
            return self.inside(text, True)
        return self.total(self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk))


class Words(dict):
    """The transducer's closure over whole words: tokens from one boundary to the next, kept for words seen lately."""

    def __init__(self, transducer: Transducer, before: str):
        self.transducer, self.before = transducer, before

    def __missing__(self, word: str) -> int:
        n = self.transducer.segment(self.before + word)[0]
        if len(word) <= LONG_SEGMENT:
            if len(self) > MOST_WORDS:
                self.clear()
            self[word] = n
        return n


def compiled(path: str) -> Transducer:
    """The transducer of a model file, compiled once per process."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


_MAP = "row bigint, no bigint, head string, at_once binary, closed bigint, last binary"


def _packed(s: State | None) -> bytes | None:
    return None if s is None else repr(tuple(s)).encode()


def _unpacked(b: bytes | None) -> State | None:
    import ast

    return None if b is None else State(*ast.literal_eval(b.decode()))


def _rows(maps: list[tuple[int, int, Map]]) -> pa.Table:
    return pa.table(
        {
            "row": pa.array([r for r, _, _ in maps], pa.int64()), "no": pa.array([n for _, n, _ in maps], pa.int64()),
            "head": pa.array([m.head for *_, m in maps], pa.string()),
            "at_once": pa.array([_packed(m.at_once) for *_, m in maps], pa.binary()),
            "closed": pa.array([m.closed for *_, m in maps], pa.int64()),
            "last": pa.array([_packed(m.last) for *_, m in maps], pa.binary())
        }
    )


def _maps(t: pa.Table) -> list[Map]:
    cols = (t[c].to_pylist() for c in ("head", "at_once", "closed", "last"))
    return [Map(h, _unpacked(a), c, _unpacked(x)) for h, a, c, x in zip(*cols, strict=True)]


def _long_counts(long: DataFrame, model: str, chunk: int, fan: int) -> DataFrame:
    """(row, n_tokens) of long texts (row, text): a prefix scan over their chunks, ``fan`` maps to a block."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                for at in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([at // chunk]), pa.array([text[at : at + chunk]])],
                        ["row", "no", "text"]
                    )

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(model)
        for b in batches:
            for i in range(b.num_rows):
                m = counter.map_of(b.column(2)[i].as_py().replace(" ", SPACE))
                yield from _rows([(b.column(0)[i].as_py(), b.column(1)[i].as_py(), m)]).to_batches()

    def block(t: pa.Table) -> pa.Table:
        counter, t = compiled(model), t.sort_by("no")
        first, *rest = _maps(t)
        for m in rest:
            first = counter.joined(first, m)
        return _rows([(t["row"][0].as_py(), t["no"][0].as_py() // fan, first)])

    def whole(t: pa.Table) -> pa.Table:
        n = compiled(model).total(_maps(t.sort_by("no")))
        return pa.table({"row": t["row"][:1], "n_tokens": pa.array([n], pa.int64())})

    cores = long.sparkSession.sparkContext.defaultParallelism
    dealt = long.select("row", "text").mapInArrow(pieces, "row bigint, no bigint, text string").repartition(
        4 * cores, "row", "no"
    )
    maps = cut(dealt.mapInArrow(mapped, _MAP))
    most = maps.agg(F.max("no")).first()[0]
    while most is not None and most >= fan:  # a block's map is no larger than its first chunk's
        maps = cut(maps.groupBy("row", F.floor(F.col("no") / fan).alias("block")).applyInArrow(block, _MAP))
        most //= fan
    return maps.groupBy("row").applyInArrow(whole, "row bigint, n_tokens bigint")


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
    fan: int = 64
) -> DataFrame:
    """Bytes and tokens of every whole text under a sentencepiece BPE model, without added tokens.

    One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit); other columns are left out.
    A null or empty text has no bytes and no tokens. Ids may be null or repeated, and each row is counted on its own. No
    rows give no rows. Texts of up to ``chunk`` characters are counted where they are, without a shuffle. Longer ones are
    cut into chunks, which are dealt out and composed in blocks of ``fan``; a text without any boundary has its
    characters read by one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(text_col, F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    short = F.char_length("text") <= chunk

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(model)
        for b in batches:
            n = [counter.count(t, chunk) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    out = rows.where(short).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    long = rows.where(~short).withColumn("row", F.monotonically_increasing_id())
    found = long.select("row", "id", "n_bytes", "text")
    if not found.isEmpty():
        at = cut(found)
        counts = _long_counts(at, model, chunk, fan)
        out = out.unionByName(at.select("row", "id", "n_bytes").join(counts, "row").drop("row"))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
