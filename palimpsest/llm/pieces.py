"""SentencePiece encoding and decoding: a batched numpy Viterbi over the lattice of pieces."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow
from .words import mix64, powers, slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_BASE = 0xD6E8FEB86659FD93
#: Piece kinds and model kinds of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct words of which a worker remembers the pieces; characters of words that advance together.
REMEMBER, TOGETHER = 2_000_000, 1 << 18


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class Pieces:
    """A model file's vocabulary, and the words it has seen."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    model: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data: bytes) -> Pieces:
        pieces, scores, kinds, more = [], [], [], {"model": UNIGRAM, "dummy_prefix": True, "squeeze": True}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                pieces.append(one[1].decode())
                scores.append(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(one.get(3, NORMAL))
            elif number == 2:
                more["model"] = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("models with a character map are not handled")
                more["dummy_prefix"], more["squeeze"] = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return cls(pieces, np.array(scores, np.float64), np.array(kinds), **more)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("pieces", "scores", "kinds", "model", "dummy_prefix", "squeeze")} | {k: self.__dict__[k] for k in ("split",) if k in self.__dict__}

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (NORMAL, USER)}

    @cached_property
    def byte_ids(self) -> np.ndarray | None:
        found = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(self.kinds == BYTE)}
        return np.array([found[b] for b in range(256)]) if len(found) == 256 else None

    @cached_property
    def unknown(self) -> int:
        return int(np.flatnonzero(self.kinds == UNKNOWN)[0])

    @cached_property
    def keys(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: sorted hash keys of the pieces, their ids, and their characters to compare."""
        out = {}
        by_length: dict[int, list[int]] = {}
        for p, i in self.ids.items():
            if self.model == UNIGRAM or len(p) == 1 or i in self.split:
                by_length.setdefault(len(p), []).append(i)
        for n, ids in by_length.items():
            chars = np.array([self.pieces[i] for i in ids], f"<U{n}").view(np.uint32).reshape(-1, n)
            keys = mix64((chars.astype(np.uint64) * powers(_BASE, n)).sum(1, dtype=np.uint64))
            order = np.argsort(keys)
            out[n] = keys[order], np.array(ids)[order], chars[order]
        return out

    @cached_property
    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """A small number for each character that stands in a longer piece (others 0), and which two stand side by side in one.

        No piece reaches across two neighbours that never stand side by side,
        so texts fall apart there into words without any change of the result.
        """
        longer = [p for p in self.ids if len(p) > 1]
        number = {c: i + 1 for i, c in enumerate(sorted({c for p in longer for c in p}))}
        of = np.zeros(0x110000, np.uint16)
        for c, i in number.items():
            of[ord(c)] = i
        beside = np.zeros((len(number) + 1, len(number) + 1), bool)
        for p in longer:
            for x, y in zip(p, p[1:]):  # noqa: B905 - neighbours
                beside[number[x], number[y]] = True
        return of, beside

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)

    # -- the lattice -------------------------------------------------------

    def _arcs(self, chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every piece found in every word: word, length, id, ordered by the place where it ends; and where each place's begin."""
        many, n = chars.shape
        total = np.zeros((many, n + 1), np.uint64)
        np.cumsum(chars.astype(np.uint64) * powers(_BASE, n), axis=1, out=total[:, 1:])
        undo = powers(pow(_BASE, -1, 1 << 64), n + 1)
        found = []
        for length, (keys, ids, spelt) in self.keys.items():
            if length > n:
                continue
            h = mix64((total[:, length:] - total[:, : n + 1 - length]) * undo[: n + 1 - length])
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            rows, starts = np.nonzero(keys[at] == h)
            at = at[rows, starts]
            same = (chars[rows[:, None], starts[:, None] + np.arange(length)] == spelt[at]).all(1)
            found.append((rows[same], starts[same] + length, np.full(same.sum(), length), ids[at[same]]))
        rows, ends, lengths, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(ends, kind="stable")
        return rows[order], lengths[order], ids[order], np.searchsorted(ends[order], np.arange(n + 2))

    def _advance(self, chars: np.ndarray) -> list[np.ndarray]:
        """Best pieces of words of one length (one per row), which advance together place by place."""
        many, n = chars.shape
        arc_rows, arc_lengths, arc_ids, cut = self._arcs(chars)
        best = np.full((many, n + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.ones((many, n + 1), np.int32), np.full((many, n + 1), -1)
        floor = self.scores.min() - 10
        for j in range(1, n + 1):
            rows, lengths, ids = (x[cut[j] : cut[j + 1]] for x in (arc_rows, arc_lengths, arc_ids))
            # a single character that is no piece: an unknown, in either kind of model
            alone = np.ones(many, bool)
            alone[rows[lengths == 1]] = False
            best[alone, j] = best[alone, j - 1] + floor
            if self.model == BPE:
                fits = self._fit(piece[rows, j - lengths], ids)
                rows, lengths, ids = rows[fits], lengths[fits], ids[fits]
            else:
                # the best arc of each word: ties go to the longer piece
                gain = best[rows, j - lengths] + self.scores[ids]
                order = np.lexsort((lengths, gain, rows))
                rows, lengths, ids, gain = rows[order], lengths[order], ids[order], gain[order]
                top = np.append(rows[1:] != rows[:-1], True)[: len(rows)] & (gain > best[rows, j])
                rows, lengths, ids = rows[top], lengths[top], ids[top]
                best[rows, j] = gain[top]
            back[rows, j], piece[rows, j] = lengths, ids
        return self._walk(chars, back, piece)

    def _walk(self, chars: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        many, n = chars.shape
        at, rows, steps = np.full(many, n), np.arange(many), []
        while len(rows):
            steps.append((rows, at[rows] - back[rows, at[rows]], piece[rows, at[rows]]))
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        row, start, ids = (np.concatenate(x) for x in zip(*steps, strict=True))
        order = np.lexsort((start, row))
        row, start, ids = row[order], start[order], ids[order]
        ends = np.searchsorted(row, np.arange(many + 1))
        if (ids >= 0).all():
            return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            one: list[int] = []
            for s, p in zip(start[a:b], ids[a:b], strict=True):
                one.extend([p] if p >= 0 else self._spell(chr(chars[i, s])))
            out.append(np.array(one, np.int64))
        return out

    def _spell(self, char: str) -> list[int]:
        return [self.unknown] if self.byte_ids is None else self.byte_ids[list(char.encode("utf-8", "surrogatepass"))].tolist()

    # -- which pieces may follow each other in a merge model ----------------

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' characters by rank ends in just these two.

        Merges run from the best score down, and what is merged on one side
        doesn't depend on the other. So a sequence is what merging yields if
        and only if this holds for every two neighbours, and each prefix of a
        word has exactly one last piece that fits.
        """
        key = (left + 1) * len(self.pieces) + right
        known, verdicts = self.__dict__.setdefault("_pairs", (np.array([-1]), np.array([False])))
        at = np.searchsorted(known, key)
        at[at == len(known)] = 0
        new = np.unique(key[known[at] != key])
        if len(new):
            if len(known) > 4 * REMEMBER:
                known, verdicts = known[:1], verdicts[:1]
                new = np.unique(key)
            fits = np.array([self._follows(k // len(self.pieces) - 1, k % len(self.pieces)) for k in new.tolist()])
            place = np.searchsorted(known, new)
            known, verdicts = self.__dict__["_pairs"] = np.insert(known, place, new), np.insert(verdicts, place, fits)
            at = np.searchsorted(known, key)
        return verdicts[at]

    def _follows(self, a: int, b: int) -> bool:
        """The same for one pair: undo the merges of both sides from the last; the two ends that then meet must not merge before what was undone."""
        if a < 0:
            return True
        names, ids, split, rank = self.pieces, self.ids, self.split, self.rank
        if a in self.tied or b in self.tied:
            return self.merge(names[a] + names[b])[0] == [names[a], names[b]]
        limit = len(names)
        while True:
            joined = ids.get(names[a] + names[b])
            if joined is not None and rank[joined] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit, a = rank[a], split[a][1]
            else:  # equal pieces merge from the left, so the right one is undone first
                limit, b = rank[b] + 1, split[b][0]

    @cached_property
    def rank(self) -> list[int]:
        """Place of each piece in the order of merging; single characters come before all."""
        out = np.empty(len(self.pieces), np.int64)
        out[np.argsort(-self.scores, kind="stable")] = np.arange(len(out))
        return [-1 if len(p) == 1 else int(r) for p, r in zip(self.pieces, out, strict=True)]

    @cached_property
    def tied(self) -> frozenset[int]:
        """Longer pieces that share their score, such as runs of spaces: their merges are followed step by step."""
        scores, times = np.unique(self.scores, return_counts=True)
        shared = set(scores[times > 1].tolist())
        return frozenset(i for p, i in self.ids.items() if len(p) > 1 and self.scores[i] in shared)

    @cached_property
    def split(self) -> dict[int, tuple[int, int]]:
        """The last merge of each piece of several characters that merging its characters gives; other pieces are never used."""
        out, rank = {}, self.rank
        for p, i in self.ids.items():
            if len(p) == 1:
                continue
            parts, last = self.merge(p)
            if parts == [p]:
                out[i] = self.ids[last[0]], self.ids[last[1]]
                if max(rank[out[i][0]], rank[out[i][1]]) >= rank[i] and i not in self.tied:
                    raise ValueError(f"piece {i} ranks before its parts")
        return out

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Pieces of a short text by merging the best-scored neighbours, leftmost first; and what was merged last."""
        parts, ids, scores, last = list(text), self.ids, self.scores, None
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and scores[k] > best:
                    best, at = scores[k], i
            if at < 0:
                return parts, last
            last = parts[at], parts[at + 1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    # -- texts ---------------------------------------------------------------

    def _learn(self, flat: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add words (places in ``flat``) to the store; equal-length words advance together."""
        known, codes, ids, cuts = self.__dict__.get("_store", (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1, np.int64)))
        if len(known) + len(keys) > REMEMBER:
            known, codes, ids, cuts = known[:0], codes[:0], ids[:0], cuts[:1]
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        cut = np.flatnonzero(np.diff(sizes[order], prepend=-1))
        parts = [ids]
        for group in np.split(order, cut[1:]):
            n = int(sizes[group[0]])
            step = max(1, TOGETHER // n)
            for i in range(0, len(group), step):
                parts.extend(self._advance(flat[starts[group[i : i + step], None] + np.arange(n)]))
        lengths = np.fromiter(map(len, parts[1:]), np.int64, len(keys))
        new = np.empty(len(keys), np.int64)
        new[order] = len(cuts) - 1 + np.arange(len(keys))
        place = np.searchsorted(known, keys)
        self.__dict__["_store"] = (
            np.insert(known, place, keys),
            np.insert(codes, place, new),
            np.concatenate(parts).astype(np.int32),
            np.concatenate([cuts, cuts[-1] + np.cumsum(lengths)]),
        )

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin."""
        plain = [self.normalise(t or "") for t in texts]
        docs = np.cumsum([0, *map(len, plain)])
        flat = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        of, beside = self.chars
        kind = of[flat]
        start = np.append(True, ~beside[kind[:-1], kind[1:]])
        start[docs[:-1][docs[:-1] < len(flat)]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(flat))
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(flat)), out=total[1:])
        keys = mix64((total[ends] - total[starts]) * powers(pow(_BASE, -1, 1 << 64), len(flat))[starts] + (ends - starts).astype(np.uint64))
        some, first, back = np.unique(keys, return_index=True, return_inverse=True)
        known = self.__dict__["_store"][0] if "_store" in self.__dict__ else np.zeros(0, np.uint64)
        at = np.searchsorted(known, some)
        new = at == len(known)
        new[~new] = known[at[~new]] != some[~new]
        if new.any():
            if len(known) + new.sum() > REMEMBER:
                new[:] = True
            self._learn(flat, some[new], starts[first[new]], ends[first[new]])
        known, codes, ids, cuts = self.__dict__["_store"]
        codes = codes[np.searchsorted(known, some)][back]
        sizes = cuts[codes + 1] - cuts[codes]
        stops = np.cumsum(sizes)
        out = ids[np.arange(stops[-1]) + np.repeat(cuts[codes] - (stops - sizes), sizes)]
        return out, np.concatenate([[0], stops])[np.searchsorted(starts, docs)]

    @cached_property
    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all pieces in a row, and where each piece's begin."""
        one = lambda p, k: bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else (" ⁇ " if k == UNKNOWN else p.replace(SPACE, " ")).encode("utf-8", "surrogatepass")
        spelt = [one(p, k) for p, k in zip(self.pieces, self.kinds, strict=True)]
        return np.frombuffer(b"".join(spelt), np.uint8), np.cumsum([0, *map(len, spelt)])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids in a row, of which each text's begin at ``starts``."""
        data, cuts = self.spelling
        sizes = cuts[ids + 1] - cuts[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        out = data[np.arange(stops[-1]) + np.repeat(cuts[ids] - stops[:-1], sizes)].tobytes()
        at = stops[starts]
        skip = self.dummy_prefix
        return [out[a + (skip and out[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def _encoded(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, starts = model.encode(texts)
                back = [t is None or t == x for t, x in zip(texts, model.decode(ids, starts), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids)),
                        pa.array(back, pa.bool_()),
                    ],
                    ["doc_id", "n_ids", "ids", "round_trip"],
                )

    return run


def _decoded(shared):
    def run(batches):
        for batch in batches:
            lists = [[i for i in x or [] if i is not None] for x in batch.column("ids").to_pylist()]
            flat = np.fromiter((i for x in lists for i in x), np.int64)
            texts = shared.value.decode(flat, np.cumsum([0, *map(len, lists)]))
            known = batch.column("ids").is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t if k else None for t, k in zip(texts, known, strict=True)], pa.string())], ["doc_id", "text"])

    return run


def load(path: str = MODEL_PATH) -> Pieces:
    """Read a model file on the driver; executors get the vocabulary (a few MB) by broadcast, not by path."""
    with open(path, "rb") as f:
        model = Pieces.parse(f.read())
    if model.model == BPE:
        model.split  # noqa: B018 - worked out once, sent along
    return model


def encode(documents: DataFrame, *, path: str = MODEL_PATH) -> DataFrame:
    """Piece ids of every row (doc_id, text).

    Words are found in the text, each distinct word of a batch is encoded
    once, and words of one length advance together through the lattice of
    pieces. A unigram model takes the path with the best sum of scores; a
    merge (BPE) model takes the one path whose neighbours fit, which is what
    merging by rank gives. Characters that are no piece become byte pieces,
    or the unknown piece where the model has none.

    Returns doc_id, n_ids, ids, round_trip (decoding gives the text back).
    Null or empty text: no ids. A text with U+2581 decodes it as a space:
    round_trip is false there. Repeated rows: each encoded. Empty table:
    empty. Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(load(path))
    return map_in_arrow(documents.select(F.col("doc_id").cast("long"), "text"), _encoded(shared), "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, *, path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of rows (doc_id, ids). Null ids: null text; null elements are skipped; other columns are ignored."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    return map_in_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), _decoded(shared), "doc_id long, text string")
