"""SentencePiece encoding and decoding as a shortest path through composed weighted transducers.

The machine is compiled once, on the driver, from the model's pieces and scores:

* the normaliser: spaces become ▁, with one in front of a text;
* the piece transducer: a trie whose final states give out a piece, at the weight
  of one id; a character without a piece is given out as its bytes, at the weight
  of so many ids (the byte fallback);
* the acceptor of neighbouring pieces. The model is a byte-pair one, in which a
  piece may follow another only if merging their joint text gives just these two.
  That follows from the order of merges along the border (each piece's last
  merge, the merge before, and so on), so the acceptor is a table of merges and
  one of last merges; it bars a pair that would have merged across the border.

The machine is composed with each text, and the path of least weight in the
tropical semiring is the segmentation. Every beginning of a text has one
byte-pair segmentation, so a state of the composition is a position, with the
piece that ends there. No piece holds two characters side by side that no piece
of the vocabulary holds so; there the composition falls into parts of their own.
All new parts of a batch are walked together, one position at a time, and what
frequent words gave is kept.

Defined results: null and empty texts have no pieces; of paths of equal weight
the one found from the earlier position stands; a part whose paths are all barred
is cut by merging itself; repeated rows get equal ids; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words kept at a time, the longest that is kept, characters encoded at a time, and verdicts of the acceptor kept (a power of two).
KEPT, LONGEST, CHARACTERS, VERDICTS = 500_000, 48, 1 << 19, 1 << 20
_STRETCH = re.compile(" +[^ ]*")
_NEVER = np.int32(1 << 30)


class Pieces:
    """The compiled machine; it may be broadcast, as its size is the vocabulary's."""

    def __init__(self, names: list[str], scores: list[float], byte_of: dict[int, int], plain: list[int]):
        """``byte_of``: the ids of byte pieces and their bytes; ``plain``: ids of pieces that stand for text."""
        self.byte_ids = {b: i for i, b in byte_of.items()}
        self.raw = [bytes([byte_of[i]]) if i in byte_of else name.replace(SPACE, " ").encode() for i, name in enumerate(names)]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: scores[i] for i in plain}
        self.unknown = len(names)
        # Merges in their order: equal scores are one rank.
        ranks = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = np.full(len(names) + 1, -1, np.int32)
        self.left, self.right = np.arange(len(names) + 1, dtype=np.int32), np.arange(len(names) + 1, dtype=np.int32)
        merges, lost = {}, set()
        for name, i in self.ids.items():
            if len(name) > 1:
                parts = [(self.ids.get(name[:k]), self.ids.get(name[k:])) for k in range(1, len(name))]
                merges |= {(a << 20) + b: ranks[self.scores[name]] for a, b in parts if a is not None and b is not None}
                last = self.merged(name, 2)
                if len(self.merged(name)) == 1 and all(x in self.ids for x in last):
                    self.rank[i], self.left[i], self.right[i] = ranks[self.scores[name]], self.ids[last[0]], self.ids[last[1]]
                else:
                    lost.add(name)  # no merge gives it
        self.merge_keys = np.array(sorted(merges), np.int64)
        self.merge_ranks = np.array([merges[k] for k in self.merge_keys.tolist()], np.int32)
        # The trie of pieces over numbered characters; 0 is a character that no piece holds. Those of longer pieces come first.
        joint = sorted({c for name in self.ids if len(name) > 1 for c in name})
        number = {c: i + 1 for i, c in enumerate([*joint, *sorted({c for name in self.ids for c in name}.difference(joint))])}
        self.number = np.zeros(0x110000, np.int16 if len(number) < 1 << 15 else np.int32)
        self.number[[ord(c) for c in number]] = list(number.values())
        self.joint = len(joint) + 1
        nodes, edges, finals = {"": 0}, {}, [-1]
        for name, i in self.ids.items():
            if name in lost:
                continue
            for k in range(1, len(name) + 1):
                if name[:k] not in nodes:
                    nodes[name[:k]] = len(nodes)
                    edges[(nodes[name[: k - 1]] << 20) + number[name[k - 1]]] = nodes[name[:k]]
                    finals.append(-1)
            finals[nodes[name]] = i
        self.edge_keys = np.array(sorted(edges), np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_keys.tolist()], np.int32)
        self.finals = np.array(finals, np.int32)
        self.roots = np.zeros(len(number) + 1, np.int32)
        for c, i in number.items():
            self.roots[i] = nodes.get(c, 0)
        #: By two numbers: whether a piece holds the characters side by side.
        self.inside = np.zeros(self.joint**2, bool)
        self.inside[[number[a] * self.joint + number[b] for name in self.ids for a, b in zip(name, name[1:])]] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("kept", "asked", "verdicts")}

    @classmethod
    def of_model(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls(names, [model.get_score(i) for i in range(n)], {i: int(names[i][3:5], 16) for i in range(n) if model.is_byte(i)}, plain)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The text's symbols after all merges, best score first, leftmost of equals, while there are more than ``until``."""
        parts, none = list(text), -float("inf")
        score = self.scores.get
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while len(parts) > until and (best := max(pairs)) > none:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.int64) << 20) + b
        at = np.minimum(np.searchsorted(self.merge_keys, keys), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == keys, self.merge_ranks[at], _NEVER)

    def accepts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece of ``b`` may follow that of ``a``: no merge across their border comes before those that gave the two."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), _NEVER)
        a, b = a.copy(), b.copy()
        while len(at):
            barred = self._merge_rank(a, b) < limit
            out[at[barred]] = False
            # The piece that was merged last is taken apart: that of the higher rank, of equals the right one.
            ra, rb = self.rank[a], self.rank[b]
            go_on = ~barred & ((ra >= 0) | (rb >= 0))
            first = ra > rb
            limit = np.where(first, ra, rb + 1)[go_on]
            a, b, at = np.where(first, self.right[a], a)[go_on], np.where(first, b, self.left[b])[go_on], at[go_on]
        return out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``accepts``, with earlier verdicts kept by a hash of the pair."""
        keys = (a.astype(np.int64) << 20) + b + 1
        spot = ((keys * 0x9E3779B97F4A7C1) >> 20) & (VERDICTS - 1)
        new = np.flatnonzero(self.asked[spot] != keys)
        if len(new):
            some, back = np.unique(keys[new], return_inverse=True)
            found = self.accepts(((some - 1) >> 20).astype(np.int32), ((some - 1) & 0xFFFFF).astype(np.int32))
            out = np.empty(len(keys), bool)
            old = np.ones(len(keys), bool)
            old[new] = False
            out[old], out[new] = self.verdicts[spot[old]], found[back]
            where = ((some * 0x9E3779B97F4A7C1) >> 20) & (VERDICTS - 1)
            where, one = np.unique(where, return_index=True)
            self.asked[where], self.verdicts[where] = some[one], found[one]
            return out
        return self.verdicts[spot]

    def paths(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, in which ▁ stands for spaces, as little-endian unsigned 32-bit numbers."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, bounds = len(points), np.r_[0, np.cumsum(sizes)]
        if not n:
            return [b""] * len(texts)
        chars = self.number[points].astype(np.int64)
        # Parts: from each text's start, and from each border that no piece spans.
        low = np.where(chars < self.joint, chars, 0)
        border = np.r_[True, ~self.inside[low[:-1] * self.joint + low[1:]], True]
        border[bounds] = True
        starts = np.flatnonzero(border)
        part = np.cumsum(border[:-1]) - 1
        starts, ends = starts[:-1], starts[1:]
        step = np.arange(n) - starts[part]
        # Arcs (from, to, piece) of the trie composed with the parts.
        node = self.roots[chars].astype(np.int64)
        at = np.flatnonzero(self.finals[node] < 0)  # node 0, the root, has no piece
        arcs = [(at, at + 1, np.full(len(at), self.unknown, np.int32))]
        at, k = np.flatnonzero(node), 1
        node = node[at]
        while len(at):
            piece = self.finals[node]
            arcs.append((at[piece >= 0], at[piece >= 0] + k, piece[piece >= 0]))
            go_on = at + k < ends[part[at]]
            at, node = at[go_on], node[go_on]
            keys = (node << 20) + chars[at + k]
            edge = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            hit = self.edge_keys[edge] == keys
            at, node, k = at[hit], self.edge_to[edge[hit]].astype(np.int64), k + 1
        source, target, piece = (np.concatenate(x) for x in zip(*arcs))
        cost = np.ones(len(piece), np.int32)
        bare = piece == self.unknown
        cost[bare] = 1 + (points[source[bare]] > 0x7F).astype(np.int32) + (points[source[bare]] > 0x7FF) + (points[source[bare]] > 0xFFFF)
        most = int(step.max()) + 1
        order = np.argsort(step[source].astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")
        source, target, piece, cost = source[order], target[order], piece[order], cost[order]
        cuts = np.r_[0, np.cumsum(np.bincount(step[source], minlength=most))]
        # States: the position's end, the piece that ends there, and the least weight. Ends of parts have states of their own.
        weight, last, back = np.full(n + 1, _NEVER), np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int64)
        for s in range(len(cuts) - 1):
            x, y = cuts[s], cuts[s + 1]
            a, b, p, w = source[x:y], target[x:y], piece[x:y], cost[x:y]
            if s:
                open_ = last[a] >= 0
                a, b, p, w = a[open_], b[open_], p[open_], w[open_]
                ok = self._follows(last[a], p)
                a, b, p, w = a[ok], b[ok], p[ok], weight[a[ok]] + w[ok]
            less = w < weight[b]
            b = b[less]
            weight[b], last[b], back[b] = w[less], p[less], a[less]
        # From each part's end back to its start.
        done = last[ends] >= 0
        now, own, steps = ends[done], np.flatnonzero(done), []
        while len(now):
            steps.append((own, last[now]))
            now = back[now]
            more = now > starts[own]
            now, own = now[more], own[more]
        count = np.zeros(len(starts), np.int64)
        for own, _ in steps:
            count[own] += 1
        merged = {i: self._whole("".join(map(chr, points[starts[i] : ends[i]].tolist()))) for i in np.flatnonzero(~done).tolist()}
        for i, ids in merged.items():
            count[i] = len(ids)
        stop = np.cumsum(count)
        out = np.empty(int(stop[-1]), np.int32)
        for j, (own, p) in enumerate(steps):
            out[stop[own] - 1 - j] = p
        for i, ids in merged.items():
            out[stop[i] - count[i] : stop[i]] = ids
        first = np.r_[0, stop][np.r_[part, len(starts)][bounds]]
        bare = out == self.unknown
        if bare.any():  # such a character is a part of its own, and its bytes take its place
            of = np.repeat(np.arange(len(starts)), count)[bare]
            raw = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in points[starts[of]].tolist()]
            wide = np.ones(len(out), np.int64)
            wide[bare] = [len(x) for x in raw]
            first = np.r_[0, np.cumsum(wide)][first]
            bytes_ = np.array([self.byte_ids[b] for b in range(256)], np.int32)
            spread = np.repeat(out, wide)
            spread[spread == self.unknown] = bytes_[np.concatenate(raw)]
            out = spread
        data = out.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def _whole(self, text: str) -> list[int]:
        return [i for part in self.merged(text) for i in ([self.ids[part]] if part in self.ids else [self.byte_ids[b] for b in part.encode()])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not hasattr(self, "kept"):
            self.kept: dict[str, bytes] = {}
            self.asked, self.verdicts = np.zeros(VERDICTS, np.int64), np.zeros(VERDICTS, bool)
        out, at = [], 0
        while at < len(texts):
            words, size = [], 0
            while at < len(texts) and size < CHARACTERS:
                words.append(self._words(texts[at]))
                size += len(texts[at])
                at += 1
            new = list(set().union(*words).difference(self.kept))
            if new:
                self.kept.update(zip(new, self.paths([SPACE + w.replace(" ", SPACE) for w in new])))
            out += [b"".join(map(self.kept.__getitem__, own)) for own in words]
            for w in new:
                if len(w) > LONGEST:
                    del self.kept[w]
            if len(self.kept) > KEPT:
                self.kept.clear()
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        """What stands behind each space of the normalised text that follows another character; further spaces stay in front."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [w[1:] for w in _STRETCH.findall(" " + text)]
        return text.split(" ")

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text or ""])[0]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str | None = None) -> Pieces:
    """The path defaults to the public byte-fallback model."""
    import public_tokenizers

    return Pieces.of_model(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, the ids as a binary column, their number and checksum, and the digest of the text decoded again."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            ids = own.encode_all([t or "" for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids, "n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "decoded_sha256": [hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, ids binary, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
