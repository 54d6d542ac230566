"""Operator 4: SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, documents, map_texts, sha256_hex
from .pieces import STRETCH, Pieces, load, stretches, words_of

MODEL = "piece_bpe_32k.model"
#: Bytes that a worker's memo of words may take, about; it starts anew beyond them.
MEMO_BYTES = 32 << 20
#: What an entry costs besides its characters and ids, about.
ENTRY_BYTES = 220
#: Bytes of texts that are encoded, decoded and handed on at a time.
PORTION = 1 << 20


def merge_words(words: list[str], p: Pieces) -> list[bytes]:
    """Piece ids of each word, as bytes of 32-bit numbers. All words lie in one flat symbol array and are merged in rounds.

    A round finds each word's lowest pair rank, merges its leftmost pairs of that rank that don't overlap (only the
    first one where the new piece could open a merge of no higher rank), and compacts the arrays. Rounds end when
    no word has a pair left. Characters outside the vocabulary become their UTF-8 bytes' ids.
    """
    if not words:
        return []
    flat = "".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = p.char_symbol[np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    place = np.arange(len(flat))
    word = np.repeat(np.arange(len(words)), lengths)
    # no merge crosses two neighbours that stand together in no piece, so segments end there
    near = sym[:-1] * p.width + sym[1:]
    found = np.minimum(np.searchsorted(p.touching, near), len(p.touching) - 1)
    seg = np.cumsum(np.append(True, (p.touching[found] != near) | (word[1:] != word[:-1]))) - 1

    high = np.iinfo(np.int64).max

    def look_up(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at these places; the highest rank where there is no pair."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * p.width + sym[nxt]
        found = np.minimum(np.searchsorted(p.pair_keys, key), len(p.pair_keys) - 1)
        ok = (p.pair_keys[found] == key) & (seg[at] == seg[nxt]) & (nxt > at)
        return np.where(ok, p.pair_rank[found], high), p.pair_to[found]

    rank, to = look_up(np.arange(len(sym)))
    done = []
    while len(sym):
        first = np.append(True, seg[1:] != seg[:-1])
        starts = np.flatnonzero(first)
        lowest = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(seg)))
        lowest = np.repeat(lowest, sizes)
        live = lowest < high
        if not live.all():  # segments without a pair are ready
            done.append((sym[~live], place[~live]))
            sym, place, seg, rank, to, lowest = sym[live], place[live], seg[live], rank[live], to[live], lowest[live]
            if not len(sym):
                break
        spots = np.flatnonzero(rank == lowest)
        # leftmost of overlapping pairs: every second one of a run of neighbouring spots
        order = np.arange(len(spots))
        fresh = np.append(True, np.diff(spots) != 1)
        own = seg[spots]
        first = np.append(True, own[1:] != own[:-1])
        pick = (order - np.maximum.accumulate(np.where(fresh | first, order, 0))) % 2 == 0
        # a segment whose lowest merge is not safe to make everywhere makes its first one only
        unsafe = np.repeat(np.maximum.reduceat(~p.at_once[to[spots]], np.flatnonzero(first)), np.diff(np.append(np.flatnonzero(first), len(spots))))
        pick &= first | ~unsafe
        spots = spots[pick]
        sym[spots] = to[spots]
        keep = np.ones(len(sym), bool)
        keep[spots + 1] = False
        changed = np.zeros(len(sym), bool)
        changed[spots] = True
        sym, place, seg, rank, to, changed = sym[keep], place[keep], seg[keep], rank[keep], to[keep], changed[keep]
        changed[:-1] |= changed[1:]
        at = np.flatnonzero(changed)
        rank[at], to[at] = look_up(at)

    if done:
        sym, place = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(place, kind="stable")
        sym, place = sym[order], place[order]
    ids = p.symbol_id[sym]
    bounds = np.searchsorted(place, np.append(0, np.cumsum(lengths)))
    unknown = np.flatnonzero(ids < 0)
    raw = ids.astype(np.int32).tobytes()
    out = [raw[a:b] for a, b in zip((4 * bounds[:-1]).tolist(), (4 * bounds[1:]).tolist())]
    for k in np.unique(word_at(bounds, unknown)).tolist():  # few words have a character outside the vocabulary
        own = slice(bounds[k], bounds[k + 1])
        parts = [[i] if i >= 0 else p.byte_ids[list(flat[at].encode())].tolist() for i, at in zip(ids[own].tolist(), place[own].tolist())]
        out[k] = np.array([i for part in parts for i in part], np.int32).tobytes()
    return out


def word_at(bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of the word that each place lies in."""
    return np.searchsorted(bounds, places, side="right") - 1


class Encoder:
    """Encodes whole texts; the words of a portion that are new to the memo are merged together."""

    def __init__(self, path: str):
        self.pieces = load(path)
        self.memo: dict[str, bytes] = {}  # a word's ids
        self.held = 0  # bytes of the memo

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held, new = 0, list(words)
        at = 0
        while at < len(new):  # a bounded number of characters at a time
            end, size = at, 0
            while end < len(new) and (size < 100_000 or end == at):
                size += len(new[end])
                end += 1
            found = merge_words(new[at:end], self.pieces)
            self.memo.update(zip(new[at:end], found))
            self.held += 2 * size + sum(map(len, found)) + ENTRY_BYTES * len(found)
            at = end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out, held, owners = [[] for _ in texts], [], []
        for i, text in enumerate(texts):
            for stretch in stretches(text) if text else ():
                held.append(words_of(stretch, self.pieces))
                owners.append(i)
                if len(stretch) >= STRETCH:
                    self._flush(held, owners, out)
        self._flush(held, owners, out)
        return [np.frombuffer(b"".join(parts), np.int32) for parts in out]

    def _flush(self, held: list[list[str]], owners: list[int], out: list[list[bytes]]) -> None:
        """Encode the stretches held so far and put their ids to their texts."""
        self.learn(set().union(*held))
        get = self.memo.__getitem__
        for i, words in zip(owners, held):
            out[i].append(b"".join(map(get, words)))
        held.clear()
        owners.clear()


@functools.cache
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that they share its memo."""
    return Encoder(path)


def portions(batch: pa.RecordBatch, size: int = 0):
    """A batch of (id, text as bytes) in portions (ids, texts), each of about `size` bytes or one text."""
    begin, held, total = 0, [], 0
    size = size or PORTION
    for at, raw in enumerate(batch.column(1)):
        raw = raw.as_py()
        held.append(raw.decode("utf-8", "replace"))
        total += len(raw)
        if total >= size or at + 1 == batch.num_rows:
            yield batch.column(0).slice(begin, len(held)), held
            begin, held, total = at + 1, [], 0


def decode(ids: np.ndarray, p: Pieces) -> str:
    """The text of ids: pieces joined, space signs as spaces, the one leading space dropped, bytes that are not UTF-8 as U+FFFD each."""
    if not len(ids):
        return ""
    raw = b"".join(map(p.raw.__getitem__, ids.tolist()))
    if p.names[ids[0]].startswith("▁"):
        raw = raw[1:]
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            try:
                out.append(raw[at:].decode())
                break
            except UnicodeDecodeError as e:
                out.append(raw[at : at + e.start].decode())
                out.append("�")
                at += e.start + 1
        return "".join(out)


def decimal_text(ids: np.ndarray) -> str:
    """Decimal ids joined by commas."""
    return ",".join(map(str, ids.tolist()))


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode it again: (id, n_tokens, ids, decoded), one row per input row.

    `ids` is an array of all ids. A null text counts as empty and has no ids. Ids of rows may be null or
    repeat; other columns are left out, whatever their names. `model` is a SentencePiece BPE model's path, which
    every worker must be able to open. With ``with_ids=False`` SHA-256 digests come instead: ids_sha256 of the decimal ids
    joined by commas, decoded_sha256 of the decoded text.

    Texts are worked on in portions of about `PORTION` bytes, each handed on before the next one, so a worker holds one
    portion and a memo of `MEMO_BYTES`, whatever the size of its batches.
    """
    names = ("ids", "decoded") if with_ids else ("ids_sha256", "decoded_sha256")

    def run(batches):
        encoder = worker_encoder(model)
        for batch in batches:
            for keys, texts in portions(batch):
                ids = encoder.encode(texts)
                back = [decode(x, encoder.pieces) for x in ids]
                sizes = [len(x) for x in ids]
                if with_ids:
                    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(back, pa.string())]
                else:
                    out = [pa.array([sha256_hex(x.encode()) for x in made], pa.string()) for made in (map(decimal_text, ids), back)]
                yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), *out], names=[id_col, "n_tokens", *names])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), bytes_of(text_col).alias("text"))
    return map_texts(rows, run, f"`{id_col}` {kind}, n_tokens long, {names[0]} {'array<int>' if with_ids else 'string'}, {names[1]} string")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), public_tokenizers.path(MODEL), with_ids=False)
