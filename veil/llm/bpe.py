"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can never end up in one
token, whatever is merged around them. A pre-token is therefore cut at every such pair; fragments
are encoded independently by rank-ordered merging and their ids concatenated. As fragments don't
touch each other, all fragments of a batch's new words advance together in numpy, one merge each a
round; the few that need many rounds are finished one by one with a heap. Words already encoded
are kept in a bounded table.

The vocabulary is read from a tokenizers JSON file given by path: byte-level BPE with a word-end
suffix, NFC, white space folding and lower-casing, special tokens cut out before normalization.

Defined results: null and empty texts have no tokens and decode to the empty string; a text of any
length is handled whole; repeated rows give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from veil.llm._common import flat, map_documents, sha256_hex

#: The Unicode White_Space characters, which the tokenizer's \s stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Words whose encoding a task keeps at hand (some 400 bytes each).
TABLE_ROWS = 60_000

#: Rounds in which all fragments advance together, before the rest is finished one by one.
ROUNDS = 40

_NONE = 1 << 30


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class PairTable:
    """Rank of a pair of ids, for whole arrays: hash tables in a chain, colliding pairs in the next one, which is as
    large as they need."""

    def __init__(self, ranks: dict[int, int], bits: int = 19):
        keys = np.fromiter(ranks.keys(), np.int64, len(ranks))
        values = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.levels = []
        while len(keys):
            bits = min(bits, len(keys).bit_length() + 4)
            slot = self.slot(keys, len(self.levels), bits)
            _, first = np.unique(slot, return_index=True)
            table, held = np.full(1 << bits, -1), np.full(1 << bits, _NONE)
            table[slot[first]], held[slot[first]] = keys[first], values[first]
            self.levels.append((bits, table, held))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def slot(self, keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        odd = np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * 7919 * level)
        return ((keys.astype(np.uint64) * odd) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, out = a << 20 | b, np.full(len(a), _NONE)
        for level, (bits, table, held) in enumerate(self.levels):
            slot = self.slot(keys, level, bits)
            hit = table[slot] == keys
            out[hit] = held[slot[hit]]
        return out


class ForcedBoundaryBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.ranks: dict[int, int] = {}  # pair of ids as one number -> rank
        merged = []
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks.setdefault(self.vocab[a] << 20 | self.vocab[b], rank)
            merged.append(self.vocab[a + b])
        self.merged, self.table = np.array(merged, np.int64), PairTable(self.ranks)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(f"{pattern}| ")
        self.blank = regex.compile(f"[{SPACES}]+")
        self.cut_special = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
                                         or r"(?!)")
        alphabet = byte_alphabet()
        self.middle = np.array([self.vocab[c] for c in alphabet], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in alphabet], np.int64)
        # neighbouring symbols that some token holds; any other pair is a forced boundary
        width = int(max(self.middle.max(), self.last.max())) + 1
        self.inside = np.zeros((width, width), bool)
        for token in self.vocab:
            ids = [self.vocab[x] for x in self.symbols(token)]
            self.inside[ids[:-1], ids[1:]] = True
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each pre-token."""
        blobs = [p.encode("utf-8") for p in pieces]
        data, starts = flat(blobs)
        ids = self.middle[data]
        ids[starts[1:] - 1] = self.last[data[starts[1:] - 1]]
        first = np.zeros(len(ids), bool)
        first[starts[:-1]] = True
        piece = np.cumsum(first) - 1
        first[1:] |= ~self.inside[ids[:-1], ids[1:]]
        done_ids, done_piece, done_at = [], [], []
        at = np.arange(len(ids))  # where a symbol began, to put the fragments back in order
        rank = np.full(len(ids), _NONE)
        pair = np.flatnonzero(~first[1:])
        rank[pair] = self.table.rank(ids[pair], ids[pair + 1])
        for turn in range(ROUNDS + 1):
            head = np.flatnonzero(first)
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), head)
            open_ = (best >> 32) < _NONE
            stays = np.repeat(open_, np.diff(np.r_[head, len(ids)]))
            done_ids.append(ids[~stays])
            done_piece.append(piece[~stays])
            done_at.append(at[~stays])
            if not open_.any():
                break
            if turn == ROUNDS:
                for a, b in zip(head[open_], np.r_[head, len(ids)][1:][open_]):
                    out = self.finish(ids[a:b].tolist())
                    done_ids.append(np.array([x for x, _ in out]))
                    done_piece.append(np.full(len(out), piece[a]))
                    done_at.append(at[a + np.array([i for _, i in out])])
                break
            spot = best[open_] & 0xFFFFFFFF
            ids[spot] = self.merged[rank[spot]]
            gone = stays.copy()
            gone[spot + 1] = False
            new = np.cumsum(gone) - 1  # where a symbol that remains will stand
            spot = new[spot]
            ids, piece, at, first, rank = ids[gone], piece[gone], at[gone], first[gone], rank[gone]
            rank[spot] = _NONE
            near = np.concatenate([spot, spot - 1])
            near = near[(near >= 0) & (near + 1 < len(ids))]
            near = near[~first[near + 1]]
            rank[near] = self.table.rank(ids[near], ids[near + 1])
        all_ids, all_piece = np.concatenate(done_ids), np.concatenate(done_piece)
        order = np.argsort(np.concatenate(done_at), kind="stable")
        all_ids, all_piece = all_ids[order].tolist(), all_piece[order]
        cuts = np.searchsorted(all_piece, np.arange(len(pieces) + 1)).tolist()
        return [all_ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def finish(self, ids: list[int]) -> list[tuple[int, int]]:
        """Merge one long fragment by a heap of pairs; (id, place of its first symbol) of what remains."""
        n = len(ids)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := self.ranks.get(ids[i] << 20 | ids[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = int(self.merged[r]), False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := self.ranks.get(ids[x] << 20 | ids[y], _NONE)) < _NONE:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [(ids[i], i) for i in range(n) if alive[i]]

    def learn(self, words: set[str]) -> None:
        """Encode words (runs without white space) that the table lacks."""
        new = [w for w in words if w not in self.ids_of]
        if len(self.ids_of) + len(new) > TABLE_ROWS:
            self.ids_of.clear()
            self.text_of.clear()
            new = list(words)
        if not new:
            return
        text = unicodedata.normalize("NFC", " ".join(new))
        # each character by itself: no final-sigma rule
        text = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
        found = self.pieces.findall(text)
        known = list(dict.fromkeys(p for p in found if p != " "))
        coded = self.encode_pieces(known) if known else []
        tokens = self.tokens
        shown = {p: (" ".join(map(str, c)), " ".join([tokens[i] for i in c])) for p, c in zip(known, coded)}
        at, ids, texts = 0, [], []
        for p in [*found, " "]:
            if p == " ":
                self.ids_of[new[at]], self.text_of[new[at]] = " ".join(ids), " ".join(texts)
                at, ids, texts = at + 1, [], []
            else:
                a, b = shown[p]
                ids.append(a)
                texts.append(b)

    def _split(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split() cuts there, the tokenizer doesn't
            return [w for w in self.blank.split(text) if w]
        return text.split()

    def _items(self, text: str | None) -> list[tuple[bool, str]]:
        """Words in order; True marks a special token."""
        if not text:
            return []
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += [(False, w) for w in self._split(text[at:m.start()])] + [(True, m[0])]
            at = m.end()
        return out + [(False, w) for w in self._split(text[at:])]

    def measure_all(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by one space, and the decoded text, of each text."""
        marks = tuple(self.special)
        rows = [self._items(t) if t and any(m in t for m in marks) else self._split(t or "") for t in texts]
        self.learn(set().union(*[[w for s, w in r if not s] if r and isinstance(r[0], tuple) else r for r in rows]))
        ids_of, text_of = self.ids_of, self.text_of
        out = []
        for r in rows:
            if r and isinstance(r[0], tuple):
                ids = " ".join([str(self.special[w]) if s else ids_of[w] for s, w in r])
                text = " ".join([w if s else text_of[w] for s, w in r])
            else:
                ids, text = " ".join([ids_of[w] for w in r]), " ".join([text_of[w] for w in r])
            out.append((ids.count(" ") + 1 if ids else 0, ids, text))
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.measure_all([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one space, as a vocabulary without a decoder reads."""
        return " ".join([self.tokens[i] for i in ids])


def encode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array) and decoded (string) of every document."""
    def make():
        bpe = ForcedBoundaryBpe(path)

        def run(ids, texts):
            rows = bpe.measure_all(texts)
            sizes = [r[0] for r in rows]
            numbers = np.fromstring(" ".join([r[1] for r in rows if r[1]]), np.int32, sep=" ")
            starts = np.r_[0, np.cumsum(np.array(sizes, np.int64))].astype(np.int32)
            return ids, sizes, pa.ListArray.from_arrays(starts, numbers), [r[2] for r in rows]
        return run

    return map_documents(df, make, f"doc_id {_id_type(df)}, n_tokens long, ids array<int>, decoded string", 1 << 19)


def digest_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids (decimal, one space between) and of the decoded text."""
    def make():
        bpe = ForcedBoundaryBpe(path)

        def run(ids, texts):
            rows = bpe.measure_all(texts)
            return (ids, [r[0] for r in rows], [sha256_hex(r[1].encode()) for r in rows],
                    [sha256_hex(r[2].encode("utf-8")) for r in rows])
        return run

    return map_documents(df, make, f"doc_id {_id_type(df)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
