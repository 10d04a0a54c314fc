"""Sharp bands of frequencies of whole channels, by chunks: nothing of a channel's length is in one task.

A band with sharp edges has effects at any distance: its kernel is sin(e d) / sin(d) (d: the distance, around the
channel as a circle; e: an edge).  What chunks next to each other do to one another is convolved as it is.  Between
chunks further apart, 1 / sin(d) is smooth once the two sines of the edge are taken to either side, so a chunk acts
through its moments at ``NODES`` Chebyshev nodes (an error of about 1e-15), some hundred numbers for each edge.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fibra.functions.chunks import attached
from fibra.functions.numbering import numbered
from fibra.functions.tables import frozen
from fibra.sources.signals import KEYS

#: Samples of a chunk at most; channels of fewer than four chunks are transformed whole.
BAND_CHUNK = 1 << 17
NODES = 20


def long_from(chunk: int | None = None) -> int:
    """Channels of more samples are done by chunks."""
    return 3 * (chunk or BAND_CHUNK)


def _cosines(nodes: int) -> np.ndarray:
    return np.cos((2 * np.arange(nodes) + 1) * np.pi / (2 * nodes))


def nodes_of(start: int, size: int, nodes: int = NODES) -> np.ndarray:
    """Chebyshev nodes of the places start .. start + size - 1."""
    return start + (size - 1) / 2 + size / 2 * _cosines(nodes)


def interpolation(size: int, nodes: int = NODES) -> np.ndarray:
    """Each node's polynomial (column) at each of ``size`` places (row)."""
    vander = np.polynomial.chebyshev.chebvander
    weight = np.full(nodes, 2 / nodes)
    weight[0] /= 2
    return vander((2 * np.arange(size) - (size - 1)) / size, nodes - 1) @ (vander(_cosines(nodes), nodes - 1) * weight).T


def _starts(n: int, parts: int) -> np.ndarray:
    """Where the chunks of a channel start, and its end."""
    return -(-np.arange(parts + 1, dtype=np.int64) * n // parts)


def _edges(bins: tuple[int, int], n: int) -> tuple[list[tuple[int, int]], bool]:
    """(sign, odd number) of each edge of the bins from .. to, and whether the signal itself is added; see ``banded``."""
    lo, hi = max(bins[0], 0), bins[1]
    if hi < lo:
        return [], False
    top = hi >= n // 2
    return ([] if top else [(1, 2 * hi + 1)]) + ([(-1, 2 * lo - 1)] if lo else []), top


def _turn(edge: int, at: np.ndarray, n: int) -> np.ndarray:
    """exp(i pi edge at / n), the product taken in whole numbers."""
    return np.exp(1j * np.pi * (edge * at % (2 * n)) / n)


def whole_band(x: np.ndarray, bins: tuple[int, int]) -> np.ndarray:
    j = np.arange(len(x))
    j = np.minimum(j, len(x) - j)
    return np.fft.ifft(np.fft.fft(x) * ((j >= bins[0]) & (j <= bins[1])).astype(float)).real


def bins_within(f, n: int, lo: float, hi: float, above: bool = False) -> tuple[int, int]:
    """First and last bin of n samples with lo <= f(bin) <= hi, or lo < f(bin) if ``above``."""
    every = range(n // 2 + 1)
    return (bisect_right if above else bisect_left)(every, lo, key=f), bisect_right(every, hi, key=f) - 1


def band_bins(sr: float, lo: float, hi: float):
    """The bins of a band of a transform: as ``spectra.bandpass`` takes them."""
    return lambda n: bins_within(lambda j: j * (1 / (n * (1 / sr))), n, lo, hi)


def grid_bins(sr: float, lo: float, hi: float, above: bool = False):
    """The bins of a band on ``spectra.frequency_grid``."""
    return lambda n: bins_within(lambda j: j * (sr / 2) / (n // 2), n, lo, hi, above)


def by_length(samples: DataFrame, assay: str, chunk: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The samples that are there, put together: of short channels, and of those that are done by chunks (numbered anew if they have gaps), if there are any."""
    have = samples.select(*KEYS, "sample", assay).where(F.col(assay).isNotNull())
    long = frozen(have.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.max("sample").alias("_last")).where(F.col("_n") > long_from(chunk)))
    n, gaps = long.agg(F.count(F.lit(1)), F.count_if(F.col("_last") > F.col("_n"))).first()
    if not n:
        return have, None
    keys = F.broadcast(long.select(*KEYS))
    rows = have.join(keys, KEYS, "left_semi")
    if gaps:
        rows = numbered(rows.withColumnRenamed("sample", "_was"), KEYS, ["_was"]).drop("_was")
    return have.join(keys, KEYS, "left_anti"), rows


def banded(samples: DataFrame, bins, assay: str, out: str, chunk: int | None = None) -> DataFrame:
    """recording_id, channel, sample, ``out``: of each whole channel the frequencies of ``bins`` (number of samples -> first, last).

    Bins are those of the one-sided transform.  A channel with a missing value has NULLs.
    """
    size = chunk or BAND_CHUNK
    levels = samples.groupBy(*KEYS).agg(F.max("sample").alias("_n"), (F.count(F.lit(1)) > F.count(assay)).alias("_gaps"))
    levels = levels.withColumn("_parts", F.when(F.col("_n") > long_from(size), F.ceil(F.col("_n") / size)).otherwise(F.lit(1).cast("long")))
    df = samples.select(*KEYS, "sample", F.col(assay).alias("_x"), F.floor((F.col("sample") - 1) / size).alias("_chunk"))
    df = attached(df, levels, samples, size).withColumn("_chunk", F.expr("(sample - 1) * _parts div _n"))

    def pack(pdf):
        """A chunk's values, and for each edge its moments."""
        first = pdf.iloc[0]
        n, parts, c = int(first["_n"]), int(first["_parts"]), int(first["_chunk"])
        x = pdf.sort_values("sample")["_x"].to_numpy(float)
        moments = np.zeros(0)
        if parts > 1 and not first["_gaps"]:
            start = int(_starts(n, parts)[c])
            basis = interpolation(len(x))
            at = start + np.arange(len(x), dtype=np.int64)
            moments = np.array([basis.T @ (x * _turn(e, at, n).conj()) for _, e in _edges(bins(n), n)[0]]).ravel().view(float)
        return pd.DataFrame({"recording_id": [first["recording_id"]], "channel": [first["channel"]], "_chunk": [c], "_n": [n], "_parts": [parts], "_gaps": [bool(first["_gaps"])], "x": [x.tobytes()], "m": [moments]})

    packed = frozen(df.groupBy(*KEYS, "_chunk").applyInPandas(pack, "recording_id string, channel int, _chunk long, _n long, _parts long, _gaps boolean, x binary, m array<double>"))

    def fields(pdf):
        """What the moments of all chunks that are not near do at each chunk's nodes."""
        n, parts = int(pdf["_n"].iloc[0]), int(pdf["_parts"].iloc[0])
        pdf = pdf.sort_values("_chunk")
        m = np.stack([np.asarray(v, float).view(complex).reshape(-1, NODES) for v in pdf["m"]], 1)
        starts = _starts(n, parts)
        nodes = np.stack([nodes_of(int(a), int(b - a)) for a, b in zip(starts[:-1], starts[1:])])
        rows = []
        for c in range(parts):
            far = np.ones(parts, bool)
            far[[(c - 1) % parts, c, (c + 1) % parts]] = False
            g = 1 / np.sin(np.pi * (nodes[c][:, None, None] - nodes[far][None]) / n)
            rows.append(np.einsum("tsr,esr->et", g, m[:, far], optimize=True).ravel().view(float))
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "_chunk": np.arange(parts), "f": rows})

    far = packed.where("_parts > 1 and not _gaps").select(*KEYS, "_chunk", "_n", "_parts", "m").groupBy(*KEYS).applyInPandas(fields, "recording_id string, channel int, _chunk long, f array<double>")
    c, parts = F.col("_chunk"), F.col("_parts")
    to = F.when(parts == 1, F.array(c)).otherwise(F.array((c + parts - 1) % parts, c, (c + 1) % parts))
    near = packed.select(*KEYS, "_n", "_parts", "_gaps", "x", c.alias("_from"), F.explode(to).alias("_chunk")).join(far, [*KEYS, "_chunk"], "left")

    def put(pdf):
        first = pdf.iloc[0]
        n, parts, c = int(first["_n"]), int(first["_parts"]), int(first["_chunk"])
        x = {int(k): np.frombuffer(v, float) for k, v in zip(pdf["_from"], pdf["x"])}
        own = x[c]
        start = int(_starts(n, parts)[c])
        if first["_gaps"]:
            y = np.full(len(own), np.nan)
        elif parts == 1:
            y = whole_band(own, bins(n))
        else:
            edges, top = _edges(bins(n), n)
            before, after = x[(c - 1) % parts], x[(c + 1) % parts]
            line = np.concatenate((before, own, after))
            reach = len(own) + max(len(before), len(after)) - 1
            steps = 1 << (2 * reach + 1).bit_length()
            d = np.arange(1, reach + 1, dtype=np.int64)
            taps = np.zeros(steps)
            taps[0] = sum(s * e for s, e in edges) / n
            taps[1 : reach + 1] = sum(s * np.sin(np.pi * (e * d % (2 * n)) / n) for s, e in edges) / (n * np.sin(np.pi * d / n))
            taps[steps - reach :] = taps[reach:0:-1]
            y = np.fft.irfft(np.fft.rfft(line, steps) * np.fft.rfft(taps), steps)[len(before) : len(before) + len(own)]
            if edges:
                basis = interpolation(len(own))
                at = start + np.arange(len(own), dtype=np.int64)
                for (s, e), f in zip(edges, np.asarray(first["f"], float).view(complex).reshape(-1, NODES)):
                    y += s / n * (_turn(e, at, n) * (basis @ f)).imag
            if top:
                y += own
        return pd.DataFrame({"recording_id": first["recording_id"], "channel": first["channel"], "sample": start + 1 + np.arange(len(own)), out: y})

    return near.groupBy(*KEYS, "_chunk").applyInPandas(put, f"recording_id string, channel int, sample long, {out} double")


#: Phase that a block of a low spectrum spans to either side, and the nodes that hold it.
PHASE = 12.0
PHASE_NODES = 40


def low_power(samples: DataFrame, top: float, sr: float, bins, assay: str) -> DataFrame:
    """recording_id, channel, bin, _n, power: |transform| squared by the number of samples, of the bins up to ``top`` Hz that ``bins`` (number of samples -> first, last) gives.

    A block of samples acts through its values at a few nodes; each node's series over the blocks is a chirp
    transform of its own, and the nodes are summed by bin.
    """
    width = max(1, int(PHASE / (np.pi * top / sr)))
    counts = samples.groupBy(*KEYS).agg(F.max("sample").alias("_n"))
    blocks = samples.select(*KEYS, "sample", F.col(assay).alias("_x")).withColumn("_block", F.floor((F.col("sample") - 1) / width))
    # a task takes many blocks at a time
    many = max(1, (1 << 16) // width)
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / many))
    basis = interpolation(width, PHASE_NODES)

    def moments(pdf):
        x = np.zeros(many * width)
        x[pdf["sample"].to_numpy() - 1 - int(pdf["_group"].iloc[0]) * many * width] = pdf["_x"].to_numpy()
        m = x.reshape(many, width) @ basis
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "node": np.arange(PHASE_NODES), "_group": pdf["_group"].iloc[0], "m": list(np.ascontiguousarray(m.T))})

    held = blocks.groupBy(*KEYS, "_group").applyInPandas(moments, "recording_id string, channel int, node int, _group long, m array<double>")

    def chirp(pdf):
        n, q = int(pdf["_n"].iloc[0]), int(pdf["node"].iloc[0])
        m = np.concatenate([np.asarray(v, float) for v in pdf.sort_values("_group")["m"]])
        lo, hi = bins(n)
        j = np.arange(lo, hi + 1, dtype=np.int64)
        if not len(j):
            return pd.DataFrame(columns=["recording_id", "channel", "bin", "re", "im"])
        square = lambda k: np.exp(-1j * np.pi * (width * k * k % (2 * n)) / n)
        b = np.arange(len(m), dtype=np.int64)
        span = np.arange(lo - len(m) + 1, hi + 1, dtype=np.int64)
        steps = 1 << (len(span) + len(m)).bit_length()
        got = np.fft.ifft(np.fft.fft(m * square(b), steps) * np.fft.fft(square(span).conj(), steps))[len(m) - 1 : len(m) - 1 + len(j)]
        node = nodes_of(0, width, PHASE_NODES)[q]
        got = got * square(j) * np.exp(-2j * np.pi * j * node / n)
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "channel": pdf["channel"].iloc[0], "bin": j, "re": got.real, "im": got.imag})

    parts = held.join(F.broadcast(counts), KEYS).groupBy(*KEYS, "node").applyInPandas(chirp, "recording_id string, channel int, bin long, re double, im double")
    sums = parts.groupBy(*KEYS, "bin").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).join(F.broadcast(counts), KEYS)
    return sums.select(*KEYS, "bin", "_n", ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("_n")).alias("power"))


# ---- the analytic half of a line of values that ends in zeros, by chunks of equal size ----


def padded_size(n: int) -> int:
    """Places of the transform of n values with as many zeros after them."""
    return 1 << int(np.ceil(np.log2(n + max(n, 1024))))


def _halves(d: np.ndarray, size: int) -> np.ndarray:
    """The two smooth parts of the analytic half's kernel at distances d <> 0; the second turns sign from place to place."""
    w = np.exp(2j * np.pi * d / size)
    smooth = (0.5 + 0.5j / np.tan(np.pi * d / size)) / size
    return np.stack((smooth, -w * smooth))


def analytic_moments(x: np.ndarray, start: int, chunk: int) -> np.ndarray:
    """A chunk's moments (plain, alternating) at ``NODES`` nodes, flat."""
    basis = interpolation(chunk)[: len(x)]
    sign = 1.0 - 2.0 * ((start + np.arange(len(x))) % 2)
    return np.concatenate((basis.T @ x, basis.T @ (x * sign)))


def analytic_fields(moments: np.ndarray, n: int, chunk: int, margin: int) -> np.ndarray:
    """What all chunks that are not near do at each chunk's nodes (those of the chunk and ``margin`` places to either side): chunk x lines x 2 x node.

    ``moments``: chunk x lines x 2 x node.
    """
    parts, size = len(moments), padded_size(n)
    apart = nodes_of(-margin, chunk + 2 * margin)[:, None] - nodes_of(0, chunk)[None]
    out = np.zeros(moments.shape, complex)
    for by in range(2, parts):
        for sign in (by, -by):
            table = _halves(sign * chunk + apart, size)
            to, of = (slice(by, None), slice(None, -by)) if sign > 0 else (slice(None, -by), slice(by, None))
            out[to] += np.einsum("htr,clhr->clht", table, moments[of], optimize=True)
    return out


def analytic_part(before: np.ndarray, own: np.ndarray, after: np.ndarray, field: np.ndarray, start: int, n: int, chunk: int, margin: int) -> np.ndarray:
    """The values of the frequencies from 0 to the highest one at the chunk's places and ``margin`` to either side.

    ``field``: 2 x node; ``before`` and ``after`` are the chunks next to it, of no values at an end.
    """
    size, wide = padded_size(n), chunk + 2 * margin
    line = np.zeros(3 * chunk)
    for k, x in enumerate((before, own, after)):
        line[k * chunk : k * chunk + len(x)] = x
    reach = 2 * chunk + margin
    steps = 1 << (2 * reach + 1).bit_length()
    d = np.concatenate((np.arange(1, reach + 1), np.arange(-reach, 0)))
    plain, turning = _halves(d, size)
    taps = np.zeros(steps, complex)
    taps[0] = (size // 2 + 1) / size
    taps[d] = plain + turning * (1.0 - 2.0 * (d % 2))
    y = np.fft.ifft(np.fft.fft(line, steps) * np.fft.fft(taps))[chunk - margin : 2 * chunk + margin]
    sign = 1.0 - 2.0 * ((start - margin + np.arange(wide)) % 2)
    far = interpolation(wide) @ field.T
    return y + far[:, 0] + sign * far[:, 1]
