"""SentencePiece encoding and decoding as a max-plus parallel scan.

The best segmentation of a text into pieces is a longest path, that is, a product of matrices over
(max, +). Long texts are cut into chunks. The state at a chunk's border is how many characters of the
next chunk the last piece already covers; a chunk yields the matrix of best scores from each state on
its left to each state on its right. Products of these matrices are associative, so they combine in
blocks, level by level; then the best states at all borders come down the levels again, and every
chunk traces its own pieces back, independently.

In a vocabulary whose pieces hold the blank mark in front only, no piece crosses from a letter to a
blank: words separate, a chunk's matrix has rank one between its first and last word border, and word
segmentations are kept in a cache. If no piece mixes letters with other signs, words are cut there too.
The new words of a batch are segmented together, all of one length as one array. Where a chunk has no
such border the full matrix is computed.

The model file gives pieces and scores; they are read as a unigram model (highest total score), also
when the file was made for merges. Characters without a piece become byte pieces.
"""

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from merchframe.llm.common import settle, ship_package

#: Characters of a chunk, and matrices that one step of the scan combines.
CHUNK, FAN = 16_384, 64
BLANK = "▁"
#: Words whose segmentation a worker keeps, and rows it returns at once.
CACHE_WORDS, OUT_ROWS = 300_000, 500
#: Longest word that is kept in the cache and segmented with others of its length.
WORD = 64
#: Fewer new words of a length are segmented one by one, which is then faster.
TOGETHER = 16
UNKNOWN_PENALTY = 10.0
_NONE = -np.inf


class Model:
    """Pieces and scores of a SentencePiece file."""

    _made: dict = {}

    @classmethod
    def get(cls, path: str) -> "Model":
        if path not in cls._made:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            ids = range(sp.get_piece_size())
            plain = [i for i in ids if not (
                sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
            cls._made[path] = cls(
                {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain},
                [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], sp.get_piece_size())
        return cls._made[path]

    def __init__(self, pieces: dict, byte_ids: list, size: int):
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces))
        self.unknown = min(s for _, s in pieces.values()) - UNKNOWN_PENALTY
        # A cut in front of a blank that follows another character is safe if no piece spans it.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.pairs = {p[k:k + 2] for p in pieces for k in range(len(p) - 1)}
        self.word = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        # Signs such as raised digits that count as word characters without being letters.
        odd = "".join(c for c in sorted(set("".join(self.pairs))) if c.isalnum() and not c.isdecimal() and not c.isalpha())
        letter = re.compile(rf"[^\W\d_{odd}]")
        if not any(BLANK not in p and bool(letter.match(p[0])) != bool(letter.match(p[1])) for p in self.pairs):
            self.word = re.compile(rf"{BLANK}*[^\W\d_{odd}]+|{BLANK}*(?:[\d_{odd}]|[^\w{BLANK}])+|{BLANK}+")
        self.border = re.compile(f"(?<=[^{BLANK}]){BLANK}")
        self.known: dict = {}
        # Every beginning of a piece; a beginning that is no piece itself has no id.
        self.prefixes: dict = {p[:k]: None for p in pieces for k in range(1, len(p))}
        self.prefixes.update(pieces)
        self._number_prefixes()
        self.names = [None] * size
        for piece, (i, _) in pieces.items():
            self.names[i] = piece.encode("utf-8", "surrogatepass")
        for b, i in enumerate(byte_ids):
            self.names[i] = bytes([b])
        self.spelled = pa.array(self.names, pa.binary())

    def _number_prefixes(self) -> None:
        """Arrays for many words at once: sign numbers, steps between prefixes, and the score and id of
        each prefix. Number 1 is the empty prefix."""
        order = sorted(self.prefixes)
        number = {"": 1} | {p: k for k, p in enumerate(order, 2)}
        signs = sorted({p[-1] for p in order})
        # Signs without a piece of their own stay 0: their words are segmented alone.
        self.sign = np.zeros(0x110000, np.uint16)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        # A step from a prefix by a sign, as one sorted number, and where it leads.
        self.width = len(signs) + 1
        steps = np.array([number[p[:-1]] * self.width + int(self.sign[ord(p[-1])]) for p in order], np.int64)
        by_step = np.argsort(steps)
        self.steps, self.leads = steps[by_step], np.arange(2, len(order) + 2)[by_step]
        self.sign[[ord(c) for c in signs if not self.prefixes.get(c)]] = 0
        hits = [None, None, *map(self.prefixes.get, order)]
        self.gain = np.array([h[1] if h else _NONE for h in hits])
        self.piece = np.array([h[0] if h else -1 for h in hits], np.int32)

    def edges(self, text: str, at: int):
        """(end, score, piece) of the pieces that start at a place; an unknown character is one edge."""
        out, prefixes = [], self.prefixes
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            hit = prefixes.get(text[at:end], False)
            if hit:
                out.append((end, hit[1], hit[0]))
            elif hit is False:
                break
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self.unknown, -1))
        return out

    def ids_of(self, text: str, at: int, end: int, piece: int) -> list:
        if piece >= 0:
            return [piece]
        return [self.byte_ids[b] for b in text[at:end].encode("utf-8", "surrogatepass")]

    def best(self, text: str, start: int, limit: int, end: int):
        """Best scores at start..end over pieces that begin before `limit`, and the last piece of each;
        ties to the longest last piece."""
        score, last = [_NONE] * (end - start + 1), [None] * (end - start + 1)
        score[0] = 0.0
        for at in range(start, min(limit, end)):
            s = score[at - start]
            if s == _NONE:
                continue
            for to, gain, piece in self.edges(text, at):
                if to <= end and s + gain > score[to - start]:
                    score[to - start], last[to - start] = s + gain, (at, piece)
        return score, last

    def before(self, text: str, end: int) -> list:
        """Best scores from each place 0..end to `end`."""
        score = [_NONE] * end + [0.0]
        for at in range(end - 1, -1, -1):
            score[at] = max((gain + score[to] for to, gain, _ in self.edges(text, at) if to <= end), default=_NONE)
        return score

    def trace(self, text: str, start: int, limit: int, end: int) -> tuple[float, bytes]:
        score, last = self.best(text, start, limit, end)
        steps, at = [], end
        while at > start:
            at, piece = last[at - start]
            steps.append((at, piece))
        steps.reverse()
        ends = [s[0] for s in steps[1:]] + [end]
        ids = [i for (a, p), e in zip(steps, ends) for i in self.ids_of(text, a, e, p)]
        return score[-1], array("i", ids).tobytes()

    def of_word(self, word: str) -> bytes:
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            # No piece spans a pair of characters that no piece holds, so parts between them stand alone.
            cuts = [k for k in range(1, len(word)) if word[k - 1:k + 1] not in self.pairs]
            if cuts:
                hit = b"".join([self.of_word(word[a:b]) for a, b in zip([0, *cuts], [*cuts, len(word)])])
            else:
                hit = self._segment(word)
            if len(word) <= WORD:
                self.known[word] = hit
        return hit

    def learn(self, words: set) -> None:
        """Put the segmentations of new words into the cache; `words` may be larger than the cache."""
        lengths: dict = {}
        for word in words:
            if 1 < len(word) <= WORD:
                lengths.setdefault(len(word), []).append(word)
        for n, group in lengths.items():
            if len(group) < TOGETHER:
                for word in group:
                    self.of_word(word)
                continue
            codes = np.array(group, f"<U{n}").view(np.uint32).reshape(-1, n)
            signs = self.sign[codes]
            plain = np.flatnonzero(signs.all(axis=1))
            ids, counts = self._segment_equal(signs[plain])
            flat, ends = ids.tobytes(), 4 * n * np.arange(1, len(plain) + 1)
            for k, a, b in zip(plain.tolist(), (ends - 4 * counts).tolist(), ends.tolist()):
                self.known[group[k]] = flat[a:b]

    def _segment_equal(self, signs: np.ndarray):
        """_segment() of words of one length and known signs: ids at the right end, their counts."""
        m, n = signs.shape
        score, last = np.full((n + 1, m), _NONE), np.zeros((n + 1, m), np.int32)
        piece = np.full((n + 1, m), -1, np.int32)
        score[0] = 0.0
        for at in range(n):
            rows, state = np.arange(m), np.ones(m, np.int64)
            for end in range(at + 1, min(at + self.longest, n) + 1):
                step = state * self.width + signs[rows, end - 1]
                found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                on = self.steps[found] == step
                rows, state = rows[on], self.leads[found[on]]
                if not len(rows):
                    break
                total = score[at, rows] + self.gain[state]
                up = total > score[end, rows]
                to = rows[up]
                score[end, to], last[end, to], piece[end, to] = total[up], at, self.piece[state[up]]
        ids, counts, rows = np.zeros((m, n), np.int32), np.zeros(m, np.int64), np.arange(m)
        at = np.full(m, n)
        while len(rows):
            counts[rows] += 1
            ids[rows, n - counts[rows]] = piece[at, rows]
            at = last[at, rows]
            on = at > 0
            rows, at = rows[on], at[on]
        return ids, counts

    def _segment(self, word: str) -> bytes:
        """The ids of trace() of the whole word, in one loop, since most of the time goes here."""
        n, longest, prefixes = len(word), self.longest, self.prefixes
        score, last = [_NONE] * (n + 1), [None] * (n + 1)
        score[0] = 0.0
        for at in range(n):
            s, end, single = score[at], at + 1, False
            while end <= n and end - at <= longest:
                hit = prefixes.get(word[at:end], False)
                if hit:
                    if end == at + 1:
                        single = True
                    total = s + hit[1]
                    if total > score[end]:
                        score[end], last[end] = total, (at, hit[0])
                elif hit is False:
                    break
                end += 1
            if not single and s + self.unknown > score[at + 1]:
                score[at + 1], last[at + 1] = s + self.unknown, (at, -1)
        ids, end = [], n
        while end:
            at, piece = last[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed(self.ids_of(word, at, end, piece))
            end = at
        ids.reverse()
        return array("i", ids).tobytes()

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of texts; new ones are put into the cache."""
        found = [self.word.findall(text) for text in texts]
        new = set().union(*found).difference(self.known)
        if new:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
                new = set().union(*found)
            self.learn(new)
        return found

    def words(self, text: str) -> bytes:
        known, of_word = self.known, self.of_word
        return b"".join([known.get(word) or of_word(word) for word in self.word.findall(text)])

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(self.wholes([text])[0], np.int32)

    def wholes(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as 32-bit numbers."""
        if not self.cuts:
            return [self.trace(t, 0, len(t), len(t))[1] for t in texts]
        found, known, of_word = self.split(texts), self.known, self.of_word
        return [b"".join([known.get(word) or of_word(word) for word in words]) for words in found]

    def borders(self, text: str, size: int) -> tuple[int, int] | None:
        """First safe cut that every left state has passed, and last safe cut of a chunk."""
        if not self.cuts:
            return None
        first = self.border.search(text, self.longest, size + 1)
        if first is None:
            return None
        last = text.rfind(BLANK, 0, size + 1)
        while text[last - 1] == BLANK:
            last = text.rfind(BLANK, 0, last)
        return first.start(), last

    def transfer(self, text: str, size: int) -> np.ndarray:
        """Matrix of best scores from left states to right states of a chunk, less a number of its own.

        `text` is the chunk, of `size` characters, and the longest piece less one of what follows. What lies
        between two safe cuts is the same on every path: it changes no choice, so its score is left out.
        """
        n, right = self.longest, min(self.longest - 1, len(text) - size)
        out = np.full((n, n), _NONE)
        cut = self.borders(text, size)
        if cut:
            first, last = cut
            into = np.array(self.before(text, first)[:n])
            out_of = self.best(text, last, size, size + right)[0][size - last:]
            out[:, :right + 1] = into[:, None] + np.array(out_of)
            return out
        # No safe cut: all left states at once, as vectors.
        score = np.full((size + right + 1, n), _NONE)
        for j in range(min(n, size + right + 1)):
            score[j, j] = 0.0
        for at in range(size):
            for to, gain, _ in self.edges(text, at):
                if to <= size + right:
                    np.maximum(score[to], score[at] + gain, out=score[to])
        out[:, :right + 1] = score[size:size + right + 1].T
        return out

    def chunk(self, text: str, size: int, left: int, right: int) -> bytes:
        """Ids of the pieces that begin in a chunk, between known states."""
        if left >= size:
            return b""
        cut = self.borders(text, size)
        if not cut:
            return self.trace(text, left, size, size + right)[1]
        first, last = cut
        return (self.trace(text, left, first, first)[1] + self.words(text[first:last])
                + self.trace(text, last, size, size + right)[1])

    def decode(self, ids: list, first: bool) -> str:
        text = b"".join(map(self.names.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if first and text.startswith(" ") else text

    def decode_lists(self, ids: pa.ListArray, first: pa.Array) -> pa.Array:
        """decode() of many rows at once; rows of bytes that are no UTF-8 are decoded one by one."""
        spelled = self.spelled.take(ids.flatten())
        if spelled.null_count:
            raise ValueError("ids without a spelling")
        ends = np.cumsum([0, *pc.fill_null(ids.value_lengths(), 0).to_pylist()], dtype=np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([self.decode(i, f) for i, f in zip(ids.to_pylist(), first.to_pylist())], pa.string())
        text = pc.replace_substring(text, BLANK, " ")
        return pc.if_else(pc.and_(first, pc.starts_with(text, " ")), pc.utf8_slice_codeunits(text, 1), text)


def _slices(batches):
    """Batches in small parts, so that few rows of ids are held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            yield batch.slice(at, OUT_ROWS)


def _id_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _matrices(column, n):
    return [np.frombuffer(m, np.float64).reshape(n, n) for m in column]


def _scan(parts: DataFrame, ends: DataFrame | None, n: int, levels: int) -> DataFrame:
    """Best states at the borders of all parts.

    parts: row, part, matrix; ends: row, block, left, right (of each block of FAN parts), or None for
    one block from state 0 to state 0. Returns row, part, left, right.
    """
    def combine(pdf):
        total = None
        for m in _matrices(pdf.sort_values("part")["matrix"], n):
            total = m if total is None else product(total, m)
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN, "matrix": [total.tobytes()]})

    def choose(pdf):
        pdf = pdf.sort_values("part")
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        own = _matrices(pdf["matrix"], n)
        heads = [np.where(np.arange(n) == left, 0.0, _NONE)]
        for m in own:
            heads.append((heads[-1][:, None] + m).max(axis=0))
        states = [right]
        for m, head in zip(reversed(own), reversed(heads[:-1])):
            states.append(int(np.argmax(head + m[:, states[-1]])))
        states.reverse()
        return pd.DataFrame({"row": pdf["row"], "part": pdf["part"], "left": states[:-1], "right": states[1:]})

    block = F.floor(F.col("part") / FAN).cast("long").alias("block")
    if levels > 1:
        above = settle(parts.withColumn("block", block).groupBy("row", "block").applyInPandas(
            combine, "row long, part long, matrix binary"), "matrices")
        ends = _scan(above, None, n, levels - 1).withColumnRenamed("part", "block")
        dealt = parts.withColumn("block", block).join(ends, ["row", "block"])
    else:
        dealt = parts.withColumn("block", block).withColumns({"left": F.lit(0), "right": F.lit(0)})
    return settle(dealt.groupBy("row", "block").applyInPandas(
        choose, "row long, part long, left int, right int"), "states")


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """Rows doc_id, part, ids for each chunk of each row of `docs` (doc_id, text, ...).

    Parts count from 0; a part holds the pieces that begin in its chunk (none, if one long piece covers
    it). Blanks become U+2581 and one is put in front; an empty or null text has one part without ids.
    `model_path` is read on every executor. Repeated rows are encoded each.
    """
    spark = docs.sparkSession
    ship_package(spark)
    n = Model.get(model_path).longest
    if chunk < 2 * n:
        raise ValueError(f"chunks need {2 * n} characters at least")
    shown = F.concat(F.lit(BLANK), F.replace("text", F.lit(" "), F.lit(BLANK)))
    marked = docs.select(F.col("doc_id").cast("long"), F.when(F.octet_length("text") > 0, shown).otherwise(F.lit("")).alias("text"))
    small = F.length("text") <= chunk

    names = ["doc_id", "part", "ids"]

    def whole(batches):
        model = Model.get(model_path)
        for x in _slices(batches):
            ids = _id_lists(model.wholes(x.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(np.zeros(len(ids), np.int64)), ids], names)

    def matrices(batches):
        model = Model.get(model_path)
        for pdf in batches:
            pdf["matrix"] = [model.transfer(t + a, len(t)).tobytes() for t, a in zip(pdf.pop("text"), pdf.pop("after"))]
            yield pdf

    def traced(batches):
        model = Model.get(model_path)
        for x in _slices(batches):
            text, after, left, right = (x.column(c).to_pylist() for c in ("text", "after", "left", "right"))
            if model.cuts:
                model.split(text)
            ids = _id_lists([model.chunk(t + a, len(t), j, k) for t, a, j, k in zip(text, after, left, right)])
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("part"), ids], names)

    ids = "doc_id long, part long, ids array<int>"
    short = marked.where(small).mapInArrow(whole, ids)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    chunks = marked.where(~small).select("doc_id", F.monotonically_increasing_id().alias("row"), pieces.alias("chunks"))
    chunks = settle(chunks.select("doc_id", "row", "chunks", F.posexplode("chunks").alias("part", "text")).select(
        "doc_id", "row", F.col("part").cast("long").alias("part"), "text",
        # The chunk after may be shorter than a piece; no piece then reaches beyond it.
        F.substring(F.coalesce(F.get("chunks", F.col("part") + 1), F.lit("")), 1, n - 1).alias("after")), "chunks")
    parts = settle(chunks.select("row", "part", "text", "after").mapInPandas(matrices, "row long, part long, matrix binary"), "matrices")
    most = parts.agg(F.max("part")).first()[0]
    levels, reach = 1, FAN
    while most is not None and most >= reach:
        levels, reach = levels + 1, reach * FAN
    states = _scan(parts, None, n, levels)
    long = chunks.join(states, ["row", "part"]).mapInArrow(traced, ids)
    return short.union(long)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """`encoded` (doc_id, part, ids) with the column text: a text is its parts' texts in order.

    Exact for texts without U+2581, which stands for a blank.
    """
    ship_package(encoded.sparkSession)

    def run(batches):
        model = Model.get(model_path)
        for x in _slices(batches):
            text = model.decode_lists(x.column("ids"), pc.equal(x.column("part"), 0))
            yield pa.RecordBatch.from_arrays([*map(x.column, ("doc_id", "part", "ids")), text], ["doc_id", "part", "ids", "text"])

    ids = encoded.select("doc_id", "part", "ids")
    return ids.mapInArrow(run, "doc_id long, part long, ids array<int>, text string")
