"""SentencePiece encoding and decoding by batched numpy Viterbi.

A batch of texts is one array of code points. It is cut into words wherever two
neighbours stand side by side in no piece, so no piece can span a cut; words are
told apart by 64-bit hashes, and each distinct word is encoded once. Distinct
words of one length form a matrix of code points and advance together: prefix
hashes give the hash of every substring, which is looked up among the sorted
hashes of the pieces; for each end position the best admissible last piece is
kept as backpointer.

Unigram models use the classic recursion (best sum of scores). For models that
merge pairs (BPE), sums of scores don't give the library's segmentation, so the
admissible last piece is defined by the merges: a segmentation is the model's
own exactly if no two neighbouring pieces would have been merged across their
border, and for every prefix one last piece satisfies this. The test walks down
the facing edges of the two pieces' merge trees, for all pairs of a step at once.

Words with pieces of equal rank (runs of blanks) and, for such models, words over
``LONG`` characters are merged step by step instead; the results are the same.
``PieceModel.stepwise`` counts these words; on the test documents they are fewer
than one distinct word in a thousand.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import made

BLANK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 96
#: Characters of the words that advance together.
MATRIX = 100_000
#: Distinct words that a worker remembers.
REMEMBERED = 400_000
_P = np.uint64(0x100000001B3)
_SPREAD, _TOP = np.uint64(0x9E3779B97F4A7C15), np.uint64(47)
_NONE, _ODD = -1, -2


_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))


def _pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a.astype(np.uint64) << np.uint64(21)) | b.astype(np.uint64)) * _SPREAD) >> np.uint64(44)


def _text(code: np.ndarray) -> str:
    return code.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


class PieceModel:
    """Pieces, sorted hashes and merge trees of a SentencePiece model file."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(data)
        norm, kind = m.normalizer_spec, m.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with identity normalisation and leading blanks are supported")
        if kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.unigram, self.prefix = kind == 1, bool(norm.add_dummy_prefix)
        self.pieces = [p.piece for p in m.pieces]
        self.unknown = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.byte_ids = np.full(256, self.unknown, np.int64)
        self.has_bytes = False
        out = []
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.has_bytes = i, True
                out.append(bytes([value]))
            elif p.type == 3:
                out.append(b"")
            elif p.type == 2:
                out.append(" ⁇ ".encode())
            else:
                out.append(p.piece.replace(BLANK, " ").encode())
        self.bytes = out
        own = [i for i, p in enumerate(m.pieces) if p.type in (1, 4)]
        if any(BLANK in self.pieces[i].lstrip(BLANK) for i in own):
            raise ValueError("pieces that span words aren't supported")
        self.ids = {self.pieces[i]: i for i in own}
        self.score = np.array([p.score for p in m.pieces], np.float64)
        self.longest = max(len(self.pieces[i]) for i in own)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest + LONG + 1, _P)]), dtype=np.uint64)
        self.length = np.array([len(x) for x in self.pieces])
        self.hash = np.zeros(len(self.pieces), np.uint64)
        for size in range(1, self.longest + 1):
            at = [i for i in own if len(self.pieces[i]) == size]
            if at:
                self.hash[at] = self._prefix(_codes([self.pieces[i] for i in at]))[:, -1]
        order = np.array(own)[np.argsort(self.hash[own] * _SPREAD, kind="stable")]
        self.keys, self.key_ids = self.hash[order] * _SPREAD, order
        if len(np.unique(self.keys)) != len(order):
            raise ValueError("two pieces share a hash")
        self.first = np.searchsorted(self.keys, np.arange(1 << 17, dtype=np.uint64) << _TOP).astype(np.int32)
        self.probes = int(np.bincount((self.keys >> _TOP).astype(np.int64)).max())
        self.keys = np.append(self.keys, np.zeros(self.probes, np.uint64))
        self.key_ids = np.append(self.key_ids, np.full(self.probes, _NONE)).astype(np.int32)
        self.power_at = self.power_back = np.empty(0, np.uint64)
        self.seen_pair, self.seen_apart = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.lowest = self.score[own].min() - 10.0
        self.piece_size = np.array([len(x) for x in out])
        self.tied = None
        if not self.unigram:
            self._merge_trees(own)
        self.side_by_side = self._pairs(self.pieces[i] for i in own)
        self.tied_pairs = self._pairs(x[:2] for x in self.tied_pieces) if self.tied else None
        self.known = np.array(sorted(ord(self.pieces[i]) for i in own if len(self.pieces[i]) == 1), np.uint32)
        self.stepwise = 0
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys_held", "slots", "flat", "counts", "round")}  # workers start afresh

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    @staticmethod
    def _pairs(words) -> np.ndarray:
        """A table of the pairs of neighbours in ``words``; a pair that collides with one of them is taken for one."""
        held = np.zeros(1 << 20, bool)
        pairs = np.array([(ord(a), ord(b)) for w in words for a, b in zip(w, w[1:], strict=False)], np.uint64).reshape(-1, 2)
        held[_pair_slot(pairs[:, 0], pairs[:, 1])] = True
        return held

    @staticmethod
    def _prefix(code: np.ndarray) -> np.ndarray:
        h = np.zeros((len(code), code.shape[1] + 1), np.uint64)
        for i in range(code.shape[1]):
            h[:, i + 1] = h[:, i] * _P + code[:, i] + np.uint64(1)
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Pieces of the hashes: the sorted keys are entered by their high bits."""
        h = h * _SPREAD
        at = self.first[(h >> _TOP).astype(np.int64)]
        found = np.full(h.shape, _NONE, np.int32)
        for _ in range(self.probes):
            hit = self.keys[at] == h
            found[hit] = self.key_ids[at[hit]]
            at = at + 1
        return found

    def _merge_trees(self, own: list[int]) -> None:
        """Rank of every piece, and the two parts that its own merging joins last."""
        n = len(self.pieces)
        self.rank = np.full(n + 1, -1, np.int64)
        scores = self.score[own]
        self.rank[own] = np.searchsorted(np.sort(np.unique(-scores)), -scores)
        single = [i for i in own if len(self.pieces[i]) == 1]
        self.rank[single] = -1  # there from the start
        value, count = np.unique(scores[[len(self.pieces[i]) > 1 for i in own]], return_counts=True)
        twice = set(value[count > 1])
        tied = [self.pieces[i] for i in own if len(self.pieces[i]) > 1 and self.score[i] in twice]
        self.left, self.right = np.full(n + 1, _NONE), np.full(n + 1, _NONE)
        self.whole = np.zeros(n + 1, bool)
        for i in own:
            got, last = self._merged(self.pieces[i])
            if got == [i]:
                self.whole[i] = True
                if last:
                    self.left[i], self.right[i] = last
                    if max(self.rank[last[0]], self.rank[last[1]]) >= self.rank[i]:
                        tied.append(self.pieces[i])  # made of later ones: its order isn't its rank
        self.tied_pieces = tied
        self.tied = re.compile("|".join(re.escape(x) for x in sorted(tied))) if tied else None

    def _merged(self, word: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merging step by step: ids (``_ODD`` - code point for characters without a piece), and the last pair."""
        part = list(word)
        after, before, last = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1)), None
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(part) and (i := self.ids.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, whole = heapq.heappop(heap)
            b = after[a] if part[a] else len(part)
            if b >= len(part) or part[a] + part[b] != whole or not part[b]:
                continue
            last = (self.ids.get(part[a], _NONE), self.ids.get(part[b], _NONE))
            part[a], part[b] = whole, ""
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [self.ids.get(x, _ODD - ord(x[0])) for x in part if x], last

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b stay apart when they stand side by side; answers are remembered by pair."""
        pair = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = ((pair.astype(np.uint64) * _SPREAD) >> np.uint64(44)).astype(np.int64)
        apart = self.seen_apart[slot]
        new = np.flatnonzero(self.seen_pair[slot] != pair)
        if len(new):
            apart[new] = got = self._walk(a[new].astype(np.int64), b[new].astype(np.int64))
            self.seen_pair[slot[new]] = -1
            self.seen_apart[slot[new]] = got
            self.seen_pair[slot[new]] = pair[new]
            last = self.seen_pair[slot[new]] == pair[new]  # of several pairs of one slot the last was stored
            self.seen_apart[slot[new[last]]] = got[last]
        return apart

    def _walk(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Undoes the merges of both pieces in reverse order, along the facing edges."""
        apart = np.ones(len(x), bool)
        until = np.full(len(x), np.iinfo(np.int64).max)
        open_ = np.arange(len(x))
        while len(open_):
            l, r = x[open_], y[open_]
            joined = self._find(self.hash[l] * self.power[self.length[r]] + self.hash[r])
            # a merge across the border comes before the one that was undone last
            early = (joined != _NONE) & (self.rank[joined] < until[open_])
            apart[open_[early]] = False
            rl, rr = self.rank[l], self.rank[r]
            atom_l, atom_r = self.left[l] == _NONE, self.left[r] == _NONE
            undo_l = ~atom_l & (atom_r | (rl > rr))
            undo_r = ~atom_r & ~undo_l
            # of equal ranks the left merge comes first
            until[open_] = np.where(undo_l, rl, np.where(undo_r, rr + 1, 0))
            x[open_] = np.where(undo_l, self.right[l], l)
            y[open_] = np.where(undo_r, self.left[r], r)
            open_ = open_[~early & (undo_l | undo_r)]
        return apart

    def _viterbi(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segmentations of words of one length, rows of ``code``: numbers of pieces, and all pieces word by word."""
        n, size = code.shape
        h = self._prefix(code)
        longest = min(size, self.longest)
        spans = [np.empty((0, 0), np.int32)] + [self._find(h[:, k:] - h[:, : size + 1 - k] * self.power[k]) for k in range(1, longest + 1)]
        last = np.full((n, size + 1), _NONE, np.int64)
        step = np.zeros((n, size + 1), np.int16)
        best = np.zeros((n, size + 1), np.float32) if self.unigram else None
        for end in range(1, size + 1):
            if self.unigram:
                self._best_sum(spans, code, best, last, step, end)
            else:
                self._admissible(spans, code, last, step, end)
        # backpointers, all words at once: pieces and how many from the end they are
        at, rows = np.full(n, size, np.int64), np.arange(n)
        of, piece, place = [], [], []
        while len(rows):
            here = at[rows]
            of.append(rows), piece.append(last[rows, here]), place.append(np.full(len(rows), len(place)))
            at[rows] = here = here - step[rows, here]
            rows = rows[here > 0]
        of, piece, place = (np.concatenate(x) for x in (of, piece, place))
        order = np.lexsort((-place, of))
        return np.bincount(of, minlength=n), piece[order]

    def _best_sum(self, spans, code, best, last, step, end: int) -> None:
        """Unigram: the piece with the best sum of scores up to ``end``; a character without a piece costs 10 more than any.

        Of equal sums the longer last piece wins; sums are single precision, as the library's.
        """
        lowest, score = np.float32(self.lowest), self.score.astype(np.float32)
        best[:, end] = -np.inf
        for k in range(min(end, self.longest), 0, -1):
            piece = spans[k][:, end - k]
            gain = np.where(piece == _NONE, lowest if k == 1 else np.float32(-np.inf), score[piece])
            value = best[:, end - k] + gain
            better = value > best[:, end]
            best[better, end], step[better, end] = value[better], k
            last[better, end] = np.where(piece == _NONE, _ODD - code[:, end - k].astype(np.int64), piece)[better]

    def _admissible(self, spans, code, last, step, end: int) -> None:
        """BPE: the one last piece that stays apart from the piece before it, sought from the longest down."""
        rows = np.arange(len(code))
        for k in range(min(end, self.longest), 0, -1):
            piece = spans[k][rows, end - k]
            if k == 1:
                odd = rows[piece == _NONE]
                last[odd, end], step[odd, end] = _ODD - code[odd, end - 1].astype(np.int64), 1
            at = np.flatnonzero(piece != _NONE)
            if not len(at):
                continue
            piece = piece[at]
            before = last[rows[at], end - k]
            fits = self.whole[piece]
            if end > k:
                near = np.flatnonzero(fits & (before >= 0))
                fits[near] = self._apart(before[near], piece[near])
            got = at[fits]
            last[rows[got], end], step[rows[got], end] = piece[fits], k
            if len(got):
                rows = np.delete(rows, got)
                if not len(rows):
                    break

    def _finished(self, count: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same segmentations with characters without a piece as bytes, or as one unknown piece a run."""
        odd, word = ids < 0, np.repeat(np.arange(len(count)), count)
        if self.has_bytes:
            code = np.where(odd, _ODD - ids.astype(np.int64), 0)
            size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code, wide, whole, odd = (np.repeat(x, size) for x in (code, size, ids, odd))
            value = code >> 6 * (wide - 1 - at)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
            value = np.where(at == 0, lead | value, 0x80 | value & 0x3F)
            return np.bincount(np.repeat(word, size), minlength=len(count)), np.where(odd, self.byte_ids[np.where(odd, value, 0)], whole)
        again = np.zeros(len(ids), bool)
        again[1:] = odd[1:] & odd[:-1] & (word[1:] == word[:-1])
        return np.bincount(word[~again], minlength=len(count)), np.where(odd, self.unknown, ids)[~again]

    def _forget(self) -> None:
        self.keys_held, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.counts, self.round = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)

    def _learn(self, keys: np.ndarray, code: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Encodes the distinct words code[start : start + size] and remembers them by ``keys``."""
        flat, counts, goes_round, learnt = [self.flat], [self.counts], [self.round], []
        slow = np.zeros(len(keys), bool) if self.unigram else size > LONG
        if self.tied:
            pair = np.concatenate([[0], np.cumsum(self.tied_pairs[_pair_slot(code[:-1], code[1:])])])
            for w in np.flatnonzero(~slow & (pair[start + size - 1] > pair[start])):
                slow[w] = bool(self.tied.search(_text(code[start[w] : start[w] + size[w]])))
        order = np.argsort(size, kind="stable")
        order = order[~slow[order]]
        for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            width = int(size[group[0]]) if len(group) else 1
            rows = max(64, MATRIX // width)
            for a in range(0, len(group), rows):
                part = group[a : a + rows]
                matrix = code[start[part][:, None] + np.arange(width)].astype(np.uint64)
                count, ids = self._viterbi(matrix)
                self._add(matrix.ravel(), np.full(len(part), width), count, ids, flat, counts, goes_round)
                learnt.append(part)
        for w in np.flatnonzero(slow):
            word = code[start[w] : start[w] + size[w]]
            ids = np.array(self._merged(_text(word))[0], np.int64)
            self._add(word.astype(np.uint64), size[w : w + 1], np.array([len(ids)]), ids, flat, counts, goes_round)
            learnt.append(np.array([w]))
            self.stepwise += 1
        first = len(self.counts)
        self.flat, self.counts, self.round = np.concatenate(flat), np.concatenate(counts), np.concatenate(goes_round)
        self.starts = np.cumsum(self.counts) - self.counts
        slots = np.empty(len(keys), np.int64)
        slots[np.concatenate(learnt)] = np.arange(first, first + len(keys))
        held, at = np.concatenate([self.keys_held, keys]), np.concatenate([self.slots, slots])
        order = np.argsort(held)
        self.keys_held, self.slots = held[order], at[order]

    def _add(self, code: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray, flat: list, counts: list, goes_round: list) -> None:
        """Keeps the segmentations of words, one behind the other in ``code``, and whether their pieces' bytes give them back."""
        if (ids < 0).any():
            count, ids = self._finished(count, ids)
        flat.append(ids.astype(np.int32)), counts.append(count)
        back = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        said = _text(code).replace(BLANK, " ").encode("utf-8", "surrogatepass")
        wide = np.where(code == ord(BLANK), 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        ends, there = np.cumsum(np.add.reduceat(wide, np.cumsum(size) - size)), np.cumsum(np.add.reduceat(self.piece_size[ids], np.cumsum(count) - count))
        if len(ends) == len(there) and (ends == there).all() and back == said:
            goes_round.append(np.ones(len(size), bool))
        else:
            a, b = np.concatenate([[0], ends]).tolist(), np.concatenate([[0], there]).tolist()
            goes_round.append(np.array([said[a[i] : a[i + 1]] == back[b[i] : b[i + 1]] for i in range(len(size))], bool))

    def _words(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, size and key of every word of ``code``, where texts begin at ``first``."""
        cut = np.ones(len(code), bool)
        cut[1:] = ~self.side_by_side[_pair_slot(code[:-1], code[1:])]
        if not self.has_bytes:  # a run of unknown characters is one piece
            at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            known = self.known[at] == code
            cut[1:] &= known[1:] | known[:-1]
        cut[first] = True
        start = np.flatnonzero(cut)
        size = np.diff(start, append=len(code))
        if len(self.power_at) <= len(code):
            n = 1 << len(code).bit_length()
            self.power_at, self.power_back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x)]), dtype=np.uint64) for x in (_P, _INVERSE))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * self.power_at[: len(code)], dtype=np.uint64)])
        key = (total[start + size] - total[start]) * self.power_back[start]
        key = (key ^ (key >> np.uint64(31))) * _SPREAD + size.astype(np.uint64)
        return start, size, (key ^ (key >> np.uint64(29))) * _SPREAD

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of every text, as the library gives them; no ids for null or empty texts."""
        return self.encode_batch(texts)[0]

    def encode_batch(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of every text, and whether decoding them gives the text back (by its words, as decoding joins the pieces' bytes)."""
        shown = [(BLANK if self.prefix else "") + t.replace(" ", BLANK) if t else "" for t in texts]
        length = np.fromiter(map(len, shown), np.int64, len(shown))
        code = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            return [np.empty(0, np.int32) for _ in texts], np.ones(len(texts), bool)
        begin = np.cumsum(length) - length
        start, size, key = self._words(code, begin[length > 0])
        distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot, new = self._held(distinct)
        if new.any():
            if len(self.keys_held) + int(new.sum()) > REMEMBERED:
                self._forget()
                new[:] = True
            self._learn(distinct[new], code, start[at[new]], size[at[new]])
            slot, _ = self._held(distinct)
        word = slot[inverse]
        count, first = self.counts[word], self.starts[word]
        stop = np.cumsum(count)
        ids = self.flat[np.arange(stop[-1]) + np.repeat(first - (stop - count), count)]
        edge = np.searchsorted(start, np.append(begin, len(code)))  # words before each text
        cuts = np.concatenate([[0], stop])[edge]
        bad = np.concatenate([[0], np.cumsum(~self.round[word])])[edge]
        whole = (np.diff(bad) == 0) & np.array([not t or BLANK not in t for t in texts], bool)
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], whole

    def _held(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the sorted ``keys`` among the remembered words, and which of them are new."""
        if not len(self.keys_held):
            return np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys_held, keys), len(self.keys_held) - 1)
        return self.slots[at], self.keys_held[at] != keys

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    def decode_batch(self, batch: list[list[int | None] | None]) -> list[str | None]:
        """Texts of all rows, their ids checked and looked up at once; null for null."""
        flat = np.fromiter((-1 if i is None else i for ids in batch if ids is not None for i in ids), np.int64)
        flat[(flat < 0) | (flat >= len(self.bytes))] = self.unknown
        parts = list(map(self.bytes.__getitem__, flat.tolist()))
        ends = np.cumsum([0, *[0 if ids is None else len(ids) for ids in batch]]).tolist()
        texts = [b"".join(parts[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [None if ids is None else t[1:] if self.prefix and t[:1] == " " else t for ids, t in zip(batch, texts, strict=True)]


def load(path: str = MODEL) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _batches(texts: list, limit: int = 1_000_000) -> Iterator[slice]:
    """Slices of at most ``limit`` characters, or one text."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t or "") > limit:
            yield slice(start, i)
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def encode_documents(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) for every row of ``docs``.

    round_trip says whether decoding the ids gives the text back; it fails only
    for texts that hold the blank mark U+2581 themselves. Null texts have no
    ids and round_trip null; empty texts have no ids. Repeated rows are encoded
    alike. Texts of any length are encoded in whole. Other columns are ignored.
    An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(series: pd.Series) -> Iterator[pd.DataFrame]:
        m, texts = shared.value, series.to_list()
        for part in _batches(texts):
            ids, whole = m.encode_batch(texts[part])
            back = [None if t is None else w for t, w in zip(texts[part], whole.tolist(), strict=True)]
            yield pd.DataFrame({"ids": ids, "n_ids": [len(i) for i in ids], "round_trip": back})

    found = made(F.col(text_col), run, "ids array<int>, n_ids long, round_trip boolean")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), found.alias("found")).select("doc_id", "found.*")


def decode_documents(encoded: DataFrame, model: PieceModel, ids_col: str = "ids", text_out: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids in ``text_out``, which replaces a column of that name.

    Null ids give null; a null among the ids or one outside the model's range
    decodes as the unknown piece. An empty table gives an empty result.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text_of(ids: pd.Series) -> pd.Series:
        return pd.Series(shared.value.decode_batch([None if i is None else [None if v is None or v != v else int(v) for v in i] for i in ids]), dtype=object)

    return encoded.withColumn(text_out, text_of(F.col(ids_col)))


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), load())
