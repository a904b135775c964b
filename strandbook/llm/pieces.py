"""Piece vocabularies inside Spark tasks: best-score segmentation, byte-pair merging, decoding of one text."""

from __future__ import annotations

import heapq
import re
from array import array
from itertools import chain

import numpy as np

SPACE_MARK = "▁"
PAIRS = 1_000_000  # neighbouring pieces that it remembers
MEMO = 300_000  # segments that one Python worker remembers before it starts anew
RECENT = 4096  # of these, the ones not yet sorted in
AT_ONCE = 1 << 14  # segments that are relaxed together


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file with byte fallback.

    Texts are taken as they are (identity normalisation): spaces become U+2581 and one is put before a
    text that is not empty. Segments, runs of U+2581 with what follows up to the next run, are
    independent of each other, because no piece has U+2581 after another character. Models that
    normalise, add no prefix, spell no bytes, or hold pieces that users defined are refused.
    """

    def __init__(self, path: str):
        import sentencepiece

        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        norm, trained, kinds = spec.normalizer_spec, spec.trainer_spec, {p.type for p in spec.pieces}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("the model normalises its texts")
        if not trained.byte_fallback or trained.treat_whitespace_as_suffix or sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED in kinds:
            raise ValueError("the model has no byte fallback, marks word ends, or holds pieces that users defined")
        if trained.model_type not in (sentencepiece_model_pb2.TrainerSpec.BPE, sentencepiece_model_pb2.TrainerSpec.UNIGRAM):
            raise ValueError("neither a byte-pair nor a unigram model")
        self.by_merges = spec.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.scores, self.byte_ids = {}, [0] * 256
        self.ids: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                if SPACE_MARK in piece.lstrip(SPACE_MARK):
                    raise ValueError(f"{piece!r} spans a word start")
        self.is_byte = {i: b for b, i in enumerate(self.byte_ids)}
        self.spelled = [bytes([self.is_byte[i]]) if i in self.is_byte else piece.encode() for i, piece in enumerate(self.pieces)]
        if len(self.is_byte) < 256:
            raise ValueError("the model lacks some bytes")
        self.unknown = min(self.scores.values()) - 10.0
        self.segments = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")

    def split(self, text: str) -> list[str]:
        return self.segments.findall(SPACE_MARK + text.replace(" ", SPACE_MARK)) if text else []

    def bytes_of(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


class Neighbours:
    """Which neighbouring pieces byte-pair merging leaves apart, told by how each piece comes about.

    Two pieces stay apart if, going back in time through the merges that made them, the two symbols at
    the border never make a piece that merging would have preferred to what came next on either side. That
    holds where the merges that make a piece rise in rank; for the few others the two are merged outright.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.ids, scores = vocabulary.pieces, vocabulary.ids, vocabulary.scores
        self.ranks = {i: -1.0 if len(p) == 1 else -scores[p] for p, i in self.ids.items()}
        self.merger, self.halves = MergeCount(vocabulary), {}

    def made_of(self, i: int) -> tuple[int, int] | None:
        """The two pieces that merging joins last when it makes a piece; None for single characters and where ranks do not rise."""
        if i not in self.halves:
            found, text, ids = None, self.pieces[i], self.ids
            if len(text) > 1:
                for cut in range(1, len(text)):
                    a, b = ids.get(text[:cut]), ids.get(text[cut:])
                    if a is not None and b is not None and max(self.ranks[a], self.ranks[b]) < self.ranks[i] and self.merger.merge(text[:cut]) == [text[:cut]] and self.merger.merge(text[cut:]) == [text[cut:]]:
                        if self.walk(a, b, self.ranks[i]) and self.made_of(a) != () and self.made_of(b) != ():
                            found = a, b
                            break
                found = found or ()
            self.halves[i] = found
        return self.halves[i]

    def walk(self, left: int, right: int, limit: float = float("inf")) -> bool | None:
        """Whether nothing crosses the border before rank ``limit``; None if this cannot be told."""
        ranks, pieces, ids, at_left = self.ranks, self.pieces, self.ids, True
        while True:
            across = ids.get(pieces[left] + pieces[right])
            if across is not None and (ranks[across] < limit or ranks[across] == limit and not at_left):
                return False
            if ranks[left] > ranks[right]:
                limit, at_left, halves = ranks[left], True, self.made_of(left)
                if not halves:
                    return None
                left = halves[1]
            elif ranks[right] >= 0:
                limit, at_left, halves = ranks[right], False, self.made_of(right)
                if not halves:
                    return None
                right = halves[0]
            else:
                return True

    def apart(self, left: int, right: int) -> bool:
        """Whether merging leaves two neighbouring pieces as they are (left below 0: none, so whether it makes the piece)."""
        if left < 0:
            return self.merger.merge(self.pieces[right]) == [self.pieces[right]]
        told = self.walk(left, right)
        if told is None:
            want = [self.pieces[left], self.pieces[right]]
            told = self.merger.merge("".join(want)) == want
        return told


class Automaton:
    """An Aho-Corasick automaton over pieces as arrays, so that many texts advance by one character at once.

    Edges are sorted by node and character; ``fail`` leads to the longest proper suffix that is a node,
    ``link`` (the output link) to the longest one that is a piece; 0 is the root.
    """

    def __init__(self, ids: dict[str, int]):
        chars = sorted({c for piece in ids for c in piece})
        self.code = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        code, children, depth_first, self.piece = {c: i for i, c in enumerate(chars, 1)}, [{}], [], [-1]
        for piece, i in ids.items():
            node = 0
            for c in map(code.__getitem__, piece):
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    self.piece.append(-1)
                node = children[node][c]
            self.piece[node] = i
        fail, link, queue = [0] * len(children), [0] * len(children), [0]
        for node in queue:
            for c, child in children[node].items():
                back = fail[node]
                while node and back and c not in children[back]:
                    back = fail[back]
                fail[child] = children[back].get(c, 0) if node else 0
                link[child] = fail[child] if self.piece[fail[child]] >= 0 else link[fail[child]]
                queue.append(child)
        edges = sorted((node * self.width + c, child) for node, down in enumerate(children) for c, child in down.items())
        self.edges, self.to = np.array([e for e, _ in edges]), np.array([t for _, t in edges])
        self.fail, self.link, self.piece = np.array(fail), np.array(link), np.array(self.piece)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes after one more character each; 0 for a character of no piece."""
        out, at, nodes = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), nodes
        while len(at):
            keys = nodes * self.width + codes
            place = np.searchsorted(self.edges, keys)
            place[place == len(self.edges)] = 0
            hit = self.edges[place] == keys
            out[at[hit]] = self.to[place[hit]]
            again = ~hit & (nodes > 0) & (codes > 0)
            at, nodes, codes = at[again], self.fail[nodes[again]], codes[again]
        return out


class BestScore:
    """Segmentation by an Aho-Corasick automaton that drives one Viterbi pass.

    At each end position the automaton gives all pieces that end there, longest first, by its output
    links; each relaxes the best score there. Ties go to the longer last piece. A character that is no
    piece costs ``unknown`` and is spelled in bytes. For models whose scores are merge ranks only neighbours that
    merging leaves apart may follow each other (see ``Neighbours``); of all paths that these leave, the best
    score is the model's own encoding. Segments that are new are relaxed together, one character of each at a
    time; long ones are relaxed alone, since few have so many characters.
    """

    LONG = 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.memo = vocabulary, {}
        self.neighbours = Neighbours(vocabulary) if vocabulary.by_merges else None
        self.automaton = Automaton(vocabulary.ids)
        count = len(vocabulary.pieces)  # the number that stands for an unknown character; the one after it for the start
        self.length = np.array([len(p) for p in vocabulary.pieces] + [1, 0])
        self.score = np.array([vocabulary.scores.get(p, 0.0) for p in vocabulary.pieces] + [vocabulary.unknown, 0.0])
        self.unknown, self.start = count, count + 1
        self.letter = np.zeros(0x110000, bool)
        self.letter[[ord(p) for p in vocabulary.ids if len(p) == 1]] = True
        self.pairs, self.good = np.full(1, -1), np.zeros(1, bool)  # neighbours met so far, sorted
        self.recent = self.pairs, self.good  # and the latest of them
        self.single = None  # for long texts; made when the first one comes

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves each two neighbouring pieces as they are; nothing merges with an unknown character."""
        keys = left << 32 | right
        out = np.ones(len(keys), bool)
        if not self.neighbours:
            return out
        at = np.arange(len(keys))
        for known, good in ((self.pairs, self.good), self.recent):
            place = np.searchsorted(known, keys[at])
            place[place == len(known)] = 0
            hit = known[place] == keys[at]
            out[at[hit]] = good[place[hit]]
            at = at[~hit]
            if not len(at):
                return out
        fresh, back = np.unique(keys[at], return_inverse=True)
        told = np.array([self._apart(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()])
        out[at] = told[back]
        place = np.searchsorted(self.recent[0], fresh)
        self.recent = np.insert(self.recent[0], place, fresh), np.insert(self.recent[1], place, told)
        if len(self.recent[0]) > RECENT:
            if len(self.pairs) > PAIRS:
                self.pairs, self.good = self.pairs[:1], self.good[:1]
            place = np.searchsorted(self.pairs, self.recent[0][1:])
            self.pairs, self.good = np.insert(self.pairs, place, self.recent[0][1:]), np.insert(self.good, place, self.recent[1][1:])
            self.recent = self.recent[0][:1], self.recent[1][:1]
        return out

    def _apart(self, left: int, right: int) -> bool:
        if right == self.unknown or left == self.unknown and self.length[right] == 1:
            return True
        return self.neighbours.apart(-1 if left >= self.unknown else left, right)

    def solve(self, segments: list[str]) -> dict[str, bytes]:
        """The ids of each segment as 32-bit integers."""
        segments = sorted(segments, key=len, reverse=True)
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(x) for x in segments])
        place = np.cumsum(np.r_[0, sizes[:-1]])  # of a segment's first character
        first = place + np.arange(len(sizes))  # of a segment's first node; nodes lie around characters
        known, codes = self.letter[codes], self.automaton.code[codes]
        best, last = np.full(len(codes) + len(sizes), -np.inf), np.full(len(codes) + len(sizes), -1)
        best[first], last[first] = 0.0, self.start
        nodes = np.zeros(len(sizes), np.int64)
        going = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0))  # segments with a character at each offset

        def relax(end, pieces):
            begin = end - self.length[pieces]
            total = best[begin] + self.score[pieces]
            hopeful = np.flatnonzero(total > best[end])
            hopeful = hopeful[self.apart(last[begin[hopeful]], pieces[hopeful])]
            best[end[hopeful]], last[end[hopeful]] = total[hopeful], pieces[hopeful]

        for offset, live in enumerate(going.tolist()):
            nodes = self.automaton.step(nodes[:live], codes[place[:live] + offset])
            end = first[:live] + offset + 1
            strange = end[~known[place[:live] + offset]]
            relax(strange, np.full(len(strange), self.unknown))
            out = np.where(self.automaton.piece[nodes] >= 0, nodes, self.automaton.link[nodes])
            while len(out):
                more = out > 0
                out, end = out[more], end[more]
                relax(end, self.automaton.piece[out])
                out = self.automaton.link[out]
        # Back from all ends at once.
        node, owner = first + sizes, np.arange(len(segments))
        owners, ids = [], []
        while True:
            going = node > first[owner]
            if not going.any():
                break
            node, owner = node[going], owner[going]
            i = last[node]
            owners.append(owner)
            ids.append(i)
            node = node - self.length[i]
        owner, ids = np.concatenate(owners[::-1]), np.concatenate(ids[::-1])
        order = np.argsort(owner, kind="stable")
        ids, bounds = ids[order].astype(np.int32), np.cumsum(np.bincount(owner, minlength=len(segments)))
        spelled = set(np.searchsorted(bounds, np.flatnonzero(ids == self.unknown), "right").tolist())
        whole, ends = ids.tobytes(), (4 * bounds).tolist()
        return {s: self._spelled(s, ids[a // 4 : b // 4]) if k in spelled else whole[a:b] for k, (s, a, b) in enumerate(zip(segments, [0, *ends[:-1]], ends))}

    def _spelled(self, segment: str, ids: np.ndarray) -> bytes:
        """ids with unknown characters spelled in bytes."""
        out, at = array("i"), 0
        for i in ids.tolist():
            if i == self.unknown:
                out.extend(self.vocabulary.bytes_of(segment[at]))
            else:
                out.append(i)
            at += int(self.length[i])
        return out.tobytes()

    def segment(self, text: str) -> bytes:
        """As ``solve``, for one long text."""
        import ahocorasick

        if self.single is None:
            self.single = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for piece, i in self.vocabulary.ids.items():
                self.single.add_word(piece, i)
            self.single.make_automaton()
        n, none, apart = len(text), float("-inf"), {}
        score, length = self.score.tolist(), self.length.tolist()
        best, last = [0.0] + [none] * n, [self.start] + [-1] * n
        strange = [(k, self.unknown) for k, c in enumerate(text) if c not in self.vocabulary.ids]
        for end, i in heapq.merge(strange, self.single.iter(text), key=lambda x: x[0]) if strange else self.single.iter(text):
            start = end + 1 - length[i]
            total = best[start] + score[i]
            if total > best[end + 1]:
                if self.neighbours:
                    pair = last[start] << 32 | i
                    good = apart.get(pair)
                    if good is None:
                        good = apart[pair] = self._apart(last[start], i)
                    if not good:
                        continue
                best[end + 1], last[end + 1] = total, i
        ids, node = [], n
        while node:
            ids.append(last[node])
            node -= length[last[node]]
        return self._spelled(text, np.array(ids[::-1]))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        split, memo = [self.vocabulary.split(t or "") for t in texts], self.memo
        if len(memo) >= MEMO:
            memo.clear()
        new = list(set().union(*split).difference(memo))
        long = {s: self.segment(s) for s in new if len(s) > self.LONG}
        new = [s for s in new if len(s) <= self.LONG] if long else new
        for at in range(0, len(new), AT_ONCE):
            memo.update(self.solve(new[at : at + AT_ONCE]))
        if not long:
            return [b"".join(map(memo.__getitem__, s)) for s in split]
        return [b"".join([long[x] if len(x) > self.LONG else memo[x] for x in s]) for s in split]


class MergeCount:
    """Token counts by byte-pair merging with a heap and a linked list, without identifiers.

    Symbols are runs of characters of a segment, known by where they begin and end. The heap gives the adjacent
    pair whose union has the lowest rank (highest score; ties: leftmost); merging it shortens the linked
    list by one. The count is the number of initial symbols less the merges; a symbol left over that is no
    piece counts its bytes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.memo, self.letters = {}, {p for p in vocabulary.scores if len(p) == 1}
        self.ranks = {p: -s for p, s in vocabulary.scores.items() if len(p) > 1}
        self.split = vocabulary.split

    def ends(self, text: str) -> tuple[list[int], int]:
        """Where the symbol that begins at each place ends (its own place if none does), and the number of merges."""
        rank, n = self.ranks.get, len(text)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push, merges = heapq.heappop, heapq.heappush, 0
        while heap:
            _, left, middle, end = pop(heap)
            if after[left] != middle or after[middle] != end:
                continue  # one of the two has changed since
            after[left], after[middle], before[end] = end, middle, left
            merges += 1
            start = before[left]
            if start >= 0 and (r := rank(text[start:end])) is not None:
                push(heap, (r, start, left, end))
            if end < n and (r := rank(text[left : after[end]])) is not None:
                push(heap, (r, left, end, after[end]))
        return after, merges

    def merge(self, text: str) -> list[str]:
        """The symbols that are left."""
        after, out, at = self.ends(text)[0], [], 0
        while at < len(text):
            out.append(text[at : after[at]])
            at = after[at]
        return out

    def count_segment(self, text: str) -> int:
        count = len(text) - self.ends(text)[1]
        if not self.letters.issuperset(text):
            count += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in text if c not in self.letters)
        return count

    def count(self, text: str | None) -> int:
        segments, memo = self.split(text or ""), self.memo
        for s in set(segments).difference(memo):
            if len(memo) >= MEMO:
                memo.clear()
            memo[s] = self.count_segment(s)
        try:
            return sum(map(memo.__getitem__, segments))
        except KeyError:  # the memo was emptied on the way
            return sum(self.count_segment(s) for s in segments)
