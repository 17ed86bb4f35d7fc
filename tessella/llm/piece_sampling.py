"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The pieces of a vocabulary that match a text span a lattice of segmentations; a piece's
weight falls with its rank. Perturbed A-star search draws the k segmentations of the
largest Gumbel-perturbed log-probability: the best leaf of the whole lattice is an
ordinary sample; the leaves that leave its path at each node form disjoint regions whose
maxima are Gumbel variables cut off at the value just taken; the region of the largest
maximum holds the next sample, and is divided in the same way. Samples are distinct by
construction and depend on the row key alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import ragged
from tessella.llm.common import quoted

SPACE_MARK = "▁"
# Characters and pieces that a worker holds in arrays at once, whole texts apart.
GROUP = 1 << 18
_C1, _C2, _C3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback, as tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.prefix = model.normalize("a").startswith(SPACE_MARK)
        weights: dict[str, tuple[int, float]] = {}
        self.bytes = np.zeros(256, np.int32)
        surface = []
        for i in range(size):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
            else:
                rank = -score if 0 <= -score <= size else 0.0
                weights[piece] = (i, -float(np.log(rank + 2.0)))
                surface.append(piece.replace(SPACE_MARK, " ").encode("utf-8"))
        self.byte_weight = -float(np.log(size))
        # every piece and every beginning of one, by hash
        starts = sorted({p[:n] for p in weights for n in range(1, len(p) + 1)})
        codes, offsets = ragged.flatten(starts)
        keys = ragged.span_hashes(codes, offsets[:-1], offsets[1:])
        order = np.argsort(keys)
        self.index = ragged.HashIndex(keys[order])
        self.piece = np.array([weights.get(starts[i], (-1, 0.0))[0] for i in order], np.int32)
        self.weight = np.array([weights.get(starts[i], (-1, 0.0))[1] for i in order])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_ends = np.cumsum([len(s) for s in surface])
        self.surface_starts = self.surface_ends - [len(s) for s in surface]

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        return (SPACE_MARK if self.prefix else "") + text.replace(" ", SPACE_MARK)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Text of each row of ids: bytes that are no UTF-8 become replacement characters."""
        data, ends = ragged.gather(self.surface, self.surface_starts[ids], self.surface_ends[ids])
        cut, raw = ends[offsets], data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


class Lattices:
    """Lattices of distinct chunks in flat arrays.

    Chunk c starts at node ``base[c]``; node n has the edges first[n]..first[n + 1], the
    likeliest first, and the last node of a chunk has none. Each edge emits one piece.
    """

    def __init__(self, vocabulary: Vocabulary, alpha: float, codes: np.ndarray, offsets: np.ndarray):
        chunks = len(offsets) - 1
        lengths = np.diff(offsets)
        owner = np.repeat(np.arange(chunks), lengths)
        place = np.arange(len(codes))
        room = np.repeat(offsets[1:], lengths) - place
        self.base = offsets[:-1] + np.arange(chunks)
        n_nodes = len(codes) + chunks
        none = np.zeros(0, np.int64)
        source, target, piece, weight, width_of = [none], [none], [none], [none], [none]
        active, size = place, 1
        single = np.zeros(len(codes), bool)
        hasher = ragged.SpanHasher(codes)
        while len(active):
            hit, at = vocabulary.index.find(hasher.hashes(active, active + size))
            active, at = active[hit], at[hit]
            whole = vocabulary.piece[at] >= 0
            here = active[whole]
            if size == 1:
                single[here] = True
            source.append(here + owner[here])
            target.append(here + owner[here] + size)
            piece.append(vocabulary.piece[at[whole]])
            weight.append(alpha * vocabulary.weight[at[whole]])
            width_of.append(np.full(len(here), size))
            size += 1
            active = active[room[active] >= size]
        # characters without a piece are spelled in bytes, over nodes of their own
        spelled = np.flatnonzero(~single)
        byte_links = [np.zeros(0, np.int64)] * 3
        if len(spelled):
            data = [chr(c).encode("utf-8", "replace") for c in codes[spelled].tolist()]
            width = np.array([len(d) for d in data])
            ids = vocabulary.bytes[np.frombuffer(b"".join(data), np.uint8)]
            begin = np.cumsum(width) - width
            extra = n_nodes + np.cumsum(width - 1) - (width - 1)  # first own node of each
            end = spelled + owner[spelled] + 1
            source.append(spelled + owner[spelled])
            target.append(end)  # for the sums; moved to the first own node below
            piece.append(ids[begin])
            weight.append(alpha * vocabulary.byte_weight * width.astype(float))
            width_of.append(np.zeros(len(spelled), np.int64))
            inner = np.repeat(np.arange(len(spelled)), width - 1)
            nth = np.arange(len(inner)) - np.repeat(np.cumsum(width - 1) - (width - 1), width - 1)
            own = extra[inner] + nth
            following = np.where(nth + 2 < width[inner], own + 1, end[inner])
            byte_links = [own, following, ids[begin[inner] + nth + 1]]
            n_nodes += int((width - 1).sum())
        sizes = [len(s) for s in source]
        source, target, piece, weight, width_of = map(
            np.concatenate, (source, target, piece, weight, width_of)
        )
        left = np.zeros(n_nodes, np.int64)
        left[place + owner] = room
        order = np.argsort((left[source] * n_nodes + source) * 64 + width_of)
        source, target, piece, weight = source[order], target[order], piece[order], weight[order]
        width_of = width_of[order]
        beta = np.zeros(n_nodes)
        logp = np.zeros(len(source))
        edges_of = np.searchsorted(left[source], np.arange(1, int(room.max()) + 2 if len(room) else 1))
        for a, b in zip(edges_of[:-1].tolist(), edges_of[1:].tolist(), strict=True):
            value = weight[a:b] + beta[target[a:b]]
            node = source[a:b]
            begin = np.flatnonzero(np.diff(node, prepend=-1))
            top = np.maximum.reduceat(value, begin)
            count = np.diff(np.append(begin, b - a))
            total = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), begin))
            beta[node[begin]] = total
            logp[a:b] = np.minimum(value - np.repeat(total, count), 0.0)
        if len(spelled):
            mine = order >= sum(sizes[:-1])
            which = order[mine] - sum(sizes[:-1])
            target[mine] = np.where(width[which] > 1, extra[which], target[mine])
        source = np.concatenate([source, byte_links[0]])
        logp = np.concatenate([logp, np.zeros(len(byte_links[0]))])
        width_of = np.concatenate([width_of, np.zeros(len(byte_links[0]), np.int64)])
        likely = np.floor(np.exp(logp) * (1 << 20)).astype(np.int64)
        order = np.argsort(((source + 1 << 21) - likely) * 64 + width_of)
        self.node = source[order]
        self.to = np.concatenate([target, byte_links[1]])[order]
        self.piece = np.concatenate([piece, byte_links[2]])[order].astype(np.int32)
        self.logp = logp[order]
        self.p = np.exp(self.logp)
        degree = np.bincount(self.node, minlength=n_nodes)
        self.first = np.concatenate([[0], np.cumsum(degree)])
        with np.errstate(divide="ignore"):
            others = np.where(degree[self.node] > 1, np.maximum(-np.expm1(self.logp), 1e-300), 0.0)
            self.rest = np.log(others)  # of the other edges of the node


def uniform(seed: np.ndarray, step: np.ndarray, salt: int) -> np.ndarray:
    """Draws in (0, 1) that depend on the seed of the row's chunk and the step alone."""
    h = ragged.mix(seed + step.astype(np.uint64) * np.uint64(_C2) + np.uint64((salt + 1) * _C3 & (1 << 64) - 1))
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variable of a location, given that it is below the bound."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        value = location - np.log(np.exp(location - bound) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(value, bound))


class Regions:
    """Sets of leaves not yet taken: row, largest perturbed value, sample whose path leads
    there, step of that path, node, edges of the node that are taken."""

    def __init__(self, k: int):
        self.columns = [np.zeros(0, np.int64), np.zeros(0), *[np.zeros(0, np.int64)] * 3, np.zeros((0, k), np.int64)]

    def add(self, *columns: np.ndarray) -> None:
        alive = columns[1] > -np.inf
        self.columns = [np.concatenate([a, c[alive]]) for a, c in zip(self.columns, columns, strict=True)]

    def pop(self) -> list[np.ndarray]:
        """The best region of each row, taken out."""
        order = np.lexsort((-self.columns[1], self.columns[0]))
        self.columns = [c[order] for c in self.columns]
        best = np.diff(self.columns[0], prepend=-1) != 0
        out = [c[best] for c in self.columns]
        self.columns = [c[~best] for c in self.columns]
        return out


def best_of_runs(values: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """Places of the ``count`` largest finite values of each run."""
    values = values.copy()
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    lengths = (bounds[1:] - bounds[:-1])[full]
    out = []
    for _ in range(count):
        if not len(full):
            break
        top = np.maximum.reduceat(values, bounds[full])
        at = np.flatnonzero((values == np.repeat(top, lengths)) & (values > -np.inf))
        run = np.searchsorted(bounds, at, side="right")
        at = at[np.diff(run, prepend=-1) != 0]
        values[at] = -np.inf
        out.append(at)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


class Sampler:
    def __init__(self, path: str, alpha: float):
        self.vocabulary, self.alpha = vocabulary(path), alpha

    def walk(self, lattices: Lattices, node, chunk, step, seeds, salt, taken=None):
        """Ancestral sampling from the given nodes to the ends of their chunks: lists of
        (chunk, step, edge). ``taken``: edges that the first step must not take, a line per
        start, -1 for none."""
        out = []
        first, p = lattices.first, lattices.p
        while True:
            going = first[node + 1] > first[node]
            if not going.all():
                node, chunk, step = node[going], chunk[going], step[going]
                taken = taken[going] if taken is not None else None
            if not len(node):
                return out
            edge, high = first[node], first[node + 1]
            left = uniform(seeds[chunk], step, salt)
            if taken is None:
                left = left - p[edge]
                open_ = np.flatnonzero((left > 0) & (edge + 1 < high))
                left = left[open_]
                while len(open_):
                    edge[open_] += 1
                    left = left - p[edge[open_]]
                    go = (left > 0) & (edge[open_] + 1 < high[open_])
                    open_, left = open_[go], left[go]
            else:
                width = high - edge
                line = np.repeat(np.arange(len(edge)), width)
                each = np.arange(len(line)) - np.repeat(np.cumsum(width) - width, width) + edge[line]
                chance = np.where((taken[line] == each[:, None]).any(axis=1), 0.0, p[each])
                begin = np.cumsum(width) - width
                total = np.add.reduceat(chance, begin)
                run = np.cumsum(chance)
                run -= np.repeat(run[begin] - chance[begin], width)
                good = (run >= (left * total)[line]) & (chance > 0)
                # rounding may leave no edge past the draw: then the last possible one
                back = np.where(chance > 0, each, -1)
                edge = np.maximum.reduceat(back, begin)
                at = np.flatnonzero(good)
                at = at[np.diff(line[at], prepend=-1) != 0]
                edge[line[at]] = each[at]
                taken = None
            out.append((chunk, step, edge))
            node, step = lattices.to[edge], step + 1

    def samples(self, texts: list[str], seeds: np.ndarray, k: int):
        """Per sample number (rows that have it, ids, offsets, log_prob, perturbed value), and
        the (k + 1)-th perturbed value of each row."""
        n = len(texts)
        codes, offsets = ragged.flatten([self.vocabulary.normalised(t) for t in texts])
        mark, line = codes == ord(SPACE_MARK), codes == 0x0A
        cut = ragged.breaks(len(codes), offsets)
        if len(codes):
            # no piece goes from another character on to a space mark or over a line end
            cut[1:] |= mark[1:] & ~mark[:-1] | line[1:] | line[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        chunk_bounds = np.searchsorted(row, np.arange(n + 1))
        number = np.arange(len(row)) - chunk_bounds[row]
        chunk_seeds = ragged.mix(seeds[row] + number.astype(np.uint64) * np.uint64(_C1))
        hashes = ragged.span_hashes(codes, starts, ends)
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        lattices = Lattices(self.vocabulary, self.alpha, *ragged.gather(codes, starts[at], ends[at]))
        base, logp = lattices.base[inverse], lattices.logp
        chunks = np.arange(len(row))
        value = -np.log(-np.log(uniform(seeds, np.zeros(n, np.int64), 1 << 20)))
        has, branch = np.arange(n), np.full(n, -1, np.int64)
        steps = self.walk(lattices, base, chunks, np.zeros(len(chunks), np.int64), chunk_seeds, 0)
        regions, paths, results = Regions(k), [], []
        for done in range(1, k + 1):
            if steps:
                columns = [np.concatenate(c) for c in zip(*steps, strict=True)]
            else:
                columns = [np.zeros(0, np.int64)] * 3
            # steps of a chunk are numbered, so each has its place without sorting
            begin = np.concatenate([[0], np.cumsum(np.bincount(columns[0], minlength=len(row)))])
            place = begin[columns[0]] + columns[1]
            chunk, step, edge = (np.empty_like(c) for c in columns)
            for out, c in zip((chunk, step, edge), columns, strict=True):
                out[place] = c
            bounds = begin[chunk_bounds]
            paths.append((chunk, step, edge, bounds))
            total = np.concatenate([[0.0], np.cumsum(logp[edge])])
            lengths = np.diff(bounds)
            log_prob = total[bounds[1:]] - total[bounds[:-1]]
            out_offsets = np.concatenate([[0], np.cumsum(lengths[has])])
            results.append((has, lattices.piece[edge], out_offsets, log_prob[has], value[has]))
            # the leaves that leave the path at each of its new steps
            owner = np.repeat(np.arange(n), lengths)
            nth = np.arange(len(edge)) - bounds[owner]
            rest = total[:-1] - total[bounds[owner]] + lattices.rest[edge]
            rest[nth <= branch[owner]] = -np.inf
            maxima = truncated(rest, value[owner], uniform(chunk_seeds[chunk], step, (1 << 21) + done))
            best = best_of_runs(maxima, bounds, k + 1 - done)
            held = np.full((len(best), k), -1, np.int64)
            held[:, 0] = edge[best]
            regions.add(
                owner[best], maxima[best], np.full(len(best), done - 1), nth[best], lattices.node[edge[best]], held
            )
            r, g, parent, s, node, held = regions.pop()
            if done == k or not len(r):
                bound = np.full(n, -np.inf)
                bound[r] = g
                return results, bound
            has = r
            value, branch = np.full(n, -np.inf), np.full(n, -1, np.int64)
            value[r], branch[r] = g, s
            # the parent's steps before the node, another edge of it, then fresh steps
            steps, before = [], np.zeros(n)
            at_chunk, at_step = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, (chunk, step, edge, bounds) in enumerate(paths):
                mine, cut_at = r[parent == i], s[parent == i]
                total = np.concatenate([[0.0], np.cumsum(logp[edge])])
                before[mine] = total[bounds[mine] + cut_at] - total[bounds[mine]]
                take, _ = ragged.gather(np.arange(len(edge)), bounds[mine], bounds[mine] + cut_at)
                steps.append((chunk[take], step[take], edge[take]))
                at_chunk[mine], at_step[mine] = chunk[bounds[mine] + cut_at], step[bounds[mine] + cut_at]
            inner = self.walk(lattices, node, at_chunk[r], at_step[r], chunk_seeds, done, taken=held)
            later, _ = ragged.gather(chunks, at_chunk[r] + 1, chunk_bounds[r + 1])
            outer = self.walk(lattices, base[later], later, np.zeros(len(later), np.int64), chunk_seeds, done)
            steps += [*inner, *outer]
            # what is left at the node without the edge just taken
            held[:, min(done, k - 1)] = inner[0][2]
            taken = np.where(held >= 0, lattices.p[np.maximum(held, 0)], 0.0).sum(axis=1)
            more = (held >= 0).sum(axis=1) < lattices.first[node + 1] - lattices.first[node]
            with np.errstate(divide="ignore"):
                rest = before[r] + np.log(np.where(more, np.maximum(1.0 - taken, 1e-300), 0.0))
            u = uniform(chunk_seeds[at_chunk[r]], at_step[r], (1 << 22) + done)
            regions.add(r, truncated(rest, g, u), parent, s, node, held)
        return results, np.full(n, -np.inf)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def sampler(path: str, alpha: float) -> Sampler:
    return Sampler(path, alpha)


def encode_samples(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    k: int = 2,
    alpha: float = 1.0,
    seed: int = 0,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Up to k distinct segmentations of each text: id, the columns of ``keep``, sample
    (1, 2, ... by falling perturbed value), ids, log_prob, perturbed, log_inclusion.

    ``log_inclusion`` is the log-probability that a segmentation is among the k drawn,
    given the (k + 1)-th perturbed value. Draws depend on the id, ``seed`` and the text's
    places, so copies under different ids differ and repeated rows agree; NULL ids share
    one key. A NULL or empty text has one empty segmentation; a text with fewer than k
    segmentations gives all of them with log_inclusion 0. Texts are never cut. The model
    file must exist on every worker.
    """
    kept = [id_column, *[c for c in keep if c != id_column]]
    rows = df.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(kept)],
        F.coalesce(quoted(text_column), F.lit("")).alias("text"),
        F.xxhash64(F.lit(seed), quoted(id_column).cast("string")).alias("key"),
    )
    names = [f"k{i}" for i in range(len(kept))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    schema += ", sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler(path, alpha)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for start, group in ragged.arrow_groups(batch.column("text"), GROUP):
                results, bound = model.samples(group, ragged.mix(keys[start : start + len(group)]), k)
                for number, (has, ids, offsets, log_prob, value) in enumerate(results):
                    gap = log_prob - bound[has]
                    with np.errstate(over="ignore", divide="ignore"):
                        inclusion = np.where(
                            gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 700.0))))
                        )
                    inside = pa.array(has + start)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *[batch.column(c).take(inside) for c in names],
                            pa.array(np.full(len(has), number + 1, np.int32)),
                            pa.ListArray.from_arrays(
                                pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))
                            ),
                            pa.array(log_prob),
                            pa.array(value),
                            pa.array(inclusion),
                        ],
                        names=[*names, "sample", "ids", "log_prob", "perturbed", "log_inclusion"],
                    )
            ragged.give_back()

    out = rows.mapInArrow(encode, schema)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, kept, strict=True)],
        "sample", "ids", "log_prob", "perturbed", "log_inclusion",
    )


def decode(df: DataFrame, path: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """The table with the text of its ids in one more column.

    Undoes ``encode_samples`` for every text without the space mark itself, which comes
    back as a space, as SentencePiece has it. NULL ids give NULL.
    """

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = vocabulary(path)
        for rows in batches:
            lengths = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            parts, first = [], 0
            while first < len(rows):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
                part = rows.slice(first, last - first)
                ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                decoded = model.decode(ids, np.concatenate([[0], ends[first:last] - before]))
                parts.append(pa.array([t if k else None for t, k in zip(decoded, part.is_valid().to_pylist(), strict=True)], pa.string()))
                first = last
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            ragged.give_back()

    return df.withColumn(name, texts(quoted(ids_column)))
