"""The rules of a SentencePiece BPE model, read once per worker from its file."""

from __future__ import annotations

import functools

import numpy as np
import sentencepiece

#: Characters of a very long text that are worked on at a time.
STRETCH = 1 << 20
#: Stands for a space inside pieces.
SPACE = "▁"


class Pieces:
    """Vocabulary tables of one model: ids, merge ranks (lower merges first), byte ids and decoding bytes."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.n = n
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.is_plain = np.array([not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        self.ids = {self.names[i]: i for i in range(n) if self.is_plain[i]}
        self.byte_ids = np.full(256, sp.unk_id(), np.int64)
        for i in np.flatnonzero(self.is_byte):
            self.byte_ids[int(self.names[i][3:5], 16)] = i
        scores = np.array([sp.get_score(i) for i in range(n)])
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        #: merge rank by id; pieces of equal score share a rank and go from left to right
        self.rank = np.array([order[scores[i]] if self.is_plain[i] else -1 for i in range(n)], np.int64)

        pairs: dict[int, int] = {}
        chars = {c: k for k, c in enumerate(sorted({c for p in self.ids for c in p}))}
        self.symbols = dict(chars)  # single characters first, then the pieces of two characters or more
        for p in self.ids:
            self.symbols.setdefault(p, len(self.symbols))
        m = self.width = len(self.symbols) + 1
        self.symbol_id = np.full(m, -1, np.int64)
        for p, k in self.symbols.items():
            self.symbol_id[k] = self.ids.get(p, -1)
        #: a merge may be made everywhere in a word at once, unless it can open a merge that comes no later
        self.at_once = np.ones(m, bool)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if left is None or right is None:
                    continue
                pairs[left * m + right] = self.symbols[p]
                for part, name in ((left, p[:k]), (right, p[k:])):
                    if len(name) > 1 and self.rank[self.ids[name]] >= self.rank[i]:
                        self.at_once[part] = False
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pair_rank = self.rank[self.symbol_id[self.pair_to]]
        #: symbol of each code point
        self.char_symbol = np.full(0x110000, m - 1, np.int32)
        for c, k in chars.items():
            self.char_symbol[ord(c)] = k
        #: neighbours that stand side by side inside some piece; no merge crosses any other place
        self.touching = np.array(sorted({chars[a] * m + chars[b] for p in self.ids for a, b in zip(p, p[1:])}), np.int64)

        #: length of the block of spaces that a long run of spaces begins with, whatever follows; 0 if there is none
        most = max((len(p) for p in self.ids if not p.strip(SPACE)), default=1)
        runs = [sp.encode(" " * (k - 1)) for k in range(1, 4 * most + 1)]  # of k space signs
        periodic = all(runs[k - 1] == [self.ids[SPACE * most], *runs[k - most - 1]] for k in range(2 * most + 1, 4 * most + 1))
        self.space_run = most if most > 1 and periodic else 0

        #: decoding: bytes of each id, byte pieces as their byte, control pieces as nothing
        self.raw = [bytes([int(p[3:5], 16)]) if b else p.replace(SPACE, " ").encode() if ok else b"" for p, b, ok in zip(self.names, self.is_byte, self.is_plain)]
        self.raw[sp.unk_id()] = " ⁇ ".encode()

    @functools.cached_property
    def merges(self) -> dict[int, tuple[int, int]]:
        """(rank, merged symbol) by pair, for single look-ups."""
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_rank.tolist(), self.pair_to.tolist())))


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


def stretches(text: str):
    """The text with the space that encoding puts before it, in stretches that end where a space follows another character. No piece crosses such a place."""
    s = " " + text.replace(SPACE, " ")
    low = 0
    while low < len(s):
        high = s.find(" ", low + STRETCH)
        while high > 0 and s[high - 1] == " ":
            high = s.find(" ", high + 1)
        yield s[low:] if high < 0 else s[low:high]
        low = len(s) if high < 0 else high


def words_of(stretch: str, pieces: Pieces) -> list[str]:
    """Cut a stretch into the words that merge on their own, so that their joined pieces are the text's pieces.

    No piece has a space sign after another character, so a word is a run of space signs and what follows it.
    Long runs of spaces are cut into the blocks that leftmost merges make of them anyway.
    """
    out: list[str] = []
    run, most = 0, pieces.space_run
    for part in stretch.split(" ")[1:]:
        run += 1
        if part:
            while most and run > 2 * most:
                out.append(SPACE * most)
                run -= most
            out.append(SPACE * run + part)
            run = 0
    while most and run > 2 * most:
        out.append(SPACE * most)
        run -= most
    if run:
        out.append(SPACE * run)
    return out
