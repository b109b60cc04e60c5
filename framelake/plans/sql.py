"""SQL of the frames that are derived from tables, for an independent engine."""

from __future__ import annotations

from ..functions import numbers

TILES = """
frames AS (SELECT doc_id AS frame_id, lang AS stream, CAST(n_chars // 2048 AS INTEGER) AS k, n_chars AS n_bytes, list_transform(string_split(text, ''), lambda c: unicode(c) % 256) AS data FROM documents),
tiles AS (SELECT frame_id, stream, CAST(t AS INTEGER) AS tile_y, data[t * 2048 + 1:(t + 1) * 2048] AS data FROM (SELECT *, unnest(range(0, k)) AS t FROM frames))"""

YUV = (
    TILES
    + """,
quads AS (SELECT frame_id, tile_y, m, data[4 * m + 1] AS y0, data[4 * m + 2] AS u, data[4 * m + 3] AS y1, data[4 * m + 4] AS v FROM (SELECT *, unnest(range(0, 512)) AS m FROM tiles)),
yuv AS (
  SELECT frame_id, CAST(tile_y * 32 + m // 16 AS INTEGER) AS y, CAST((2 * m) % 32 AS INTEGER) AS x, y0 AS luma, u, v FROM quads
  UNION ALL SELECT frame_id, CAST(tile_y * 32 + m // 16 AS INTEGER), CAST((2 * m) % 32 + 1 AS INTEGER), y1, u, v FROM quads
)"""
)


def byte(e: str) -> str:
    return f"CAST(greatest(0, least(255, {e})) AS INTEGER)"


FIXED = f"""
  {byte("luma + ((1436 * (v - 128) + 512) >> 10)")} AS r,
  {byte("luma - ((352 * (u - 128) + 512) >> 10) - ((732 * (v - 128) + 512) >> 10)")} AS g,
  {byte("luma + ((1811 * (u - 128) + 512) >> 10)")} AS b"""
FLOAT = f"""
  {byte("CAST(trunc(luma + 1.403::DOUBLE * (v - 128)) AS INTEGER)")} AS r,
  {byte("CAST(trunc(luma - 0.344::DOUBLE * (u - 128) - 0.714::DOUBLE * (v - 128)) AS INTEGER)")} AS g,
  {byte("CAST(trunc(luma + 1.770::DOUBLE * (u - 128)) AS INTEGER)")} AS b"""
RGB = YUV + f",\nrgb AS (SELECT frame_id, y, x, {FIXED} FROM yuv)"
RGB_FLOAT = YUV + f",\nrgb AS (SELECT frame_id, y, x, {FLOAT} FROM yuv)"
BOTH = RGB + f",\nrgbf AS (SELECT frame_id, y, x, {FLOAT} FROM yuv)"

VARIANCE = (
    TILES
    + """,
luma AS (SELECT frame_id, stream, tile_y, data[2 * i + 1] AS y FROM (SELECT *, unnest(range(0, 1024)) AS i FROM tiles)),
means AS (SELECT frame_id, stream, tile_y, CAST(sum(y) AS BIGINT) AS sum_y, CAST(sum(y) // 1024 AS BIGINT) AS mean_y FROM luma GROUP BY ALL),
scored AS (
  SELECT frame_id, means.stream, tile_y, sum_y, mean_y, CAST(sum((y - mean_y) * (y - mean_y)) AS BIGINT) AS var_num, sum((y - mean_y) * (y - mean_y)) / 1024::DOUBLE AS variance
  FROM luma JOIN means USING (frame_id, tile_y) GROUP BY ALL
),
routed AS (SELECT *, CASE WHEN variance > 1000 THEN 'cnn' ELSE 'interp' END AS route FROM scored)"""
)

PATCHES = """
patch AS (SELECT vec_id AS patch_id, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 128))) AS INTEGER)) AS pix FROM embeddings),
pp AS (SELECT patch_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, pix[i + 1] AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM patch))"""

PATCH_WEIGHTS = PATCHES + ",\nw AS (SELECT patch_id AS layer, y // 4 AS out_ch, x // 4 AS in_ch, y % 4 AS ky, x % 4 AS kx, CAST(v - 128 AS BIGINT) AS w FROM pp)"


def hashed(key: str, seed: int = 0) -> str:
    return f"((CAST({key} AS BIGINT) % 1000003 * 48271 + {seed} * 69621) % 2147483647)"


def mixed(key: str, seed: int = 0) -> tuple[str, str]:
    """As functions.numbers.mixed()."""
    half = lambda x: f"({x} & {numbers.MASK})"
    key = f"CAST({key} AS BIGINT)"
    return numbers.rounds(half(f"({key} >> 32)"), half(key), seed, lambda a, b, c, k: f"xor({a}, {half(f'(({b} * {c} + {k}) >> 15)')})")


def number(key: str, seed: int = 0) -> str:
    high, low = mixed(key, seed)
    return f"((xor({high}, {1 << 31}) - {1 << 31}) * {1 << 32} + {low})"


def below(key: str, n: int, seed: int = 0) -> str:
    return f"(({mixed(key, seed)[0]} * {n}) >> 32)"


def uniform(key: str, seed: int = 0, signed: bool = False) -> str:
    high = mixed(key, seed)[0]
    return f"({high} / {1 << 31}::DOUBLE - 1)" if signed else f"({high} / {1 << 32}::DOUBLE)"


def permuted(place: str, seed: int = 0) -> str:
    """As functions.numbers.permuted(), for rows that have n and its grid a, b."""
    ks, f = numbers.keys_of(seed), numbers.FACTORS

    def turned(x: str, i: int) -> str:
        middle = f"((({x} * {f[i]} + {ks[i]}) >> 15) & {numbers.MASK >> 2})"
        return f"(({middle} * {middle}) >> 15)"

    def once(v: str) -> str:
        row, column = f"({v} // b)", f"({v} % b)"
        for i in (0, 2):
            column = f"(({column} + {turned(row, i)}) % b)"
            row = f"(({row} + {turned(column, i + 1)}) % a)"
        return f"({row} * b + {column})"

    return f"list_reduce(list_concat([{once(place)}], range({numbers.WALK})), lambda v, z: CASE WHEN v < n THEN v ELSE {once('v')} END)"


SYNTH = f"""
o AS (SELECT o_orderkey AS frame_id, o_custkey % 16 AS stream, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS texture FROM orders),
grid AS (SELECT *, CAST(i // 20 AS INTEGER) AS y, CAST(i % 20 AS INTEGER) AS x FROM (SELECT *, unnest(range(0, 400)) AS i FROM o)),
px AS (
  SELECT frame_id, stream, texture, y, x,
    CAST(CASE texture WHEN 1 THEN (y + x) % 2 * 255 WHEN 2 THEN {hashed("frame_id * 1000 + y * 20 + x")} % 256 WHEN 3 THEN x * 12 WHEN 4 THEN y % 4 * 60 ELSE 128 END AS INTEGER) AS luma
  FROM grid
)"""

EVENTS = "ev AS (SELECT event_id, ts, user_id AS stream, event_type AS status, value FROM events)"


def weights(layer: int, out_ch: int, in_ch: int, k: int) -> str:
    place = f"SELECT {layer} AS layer, CAST(i // {in_ch * k * k} AS INTEGER) AS out_ch, CAST(i // {k * k} % {in_ch} AS INTEGER) AS in_ch, CAST(i // {k} % {k} AS INTEGER) AS ky, CAST(i % {k} AS INTEGER) AS kx FROM range(0, {out_ch * in_ch * k * k}) t(i)"
    return f"(SELECT *, {hashed('((layer * 64 + out_ch) * 64 + in_ch) * 81 + ky * 9 + kx', 5)} % 2049 - 1024 AS w FROM ({place}))"


def digest(rel: str, cols: str, keys: str = "frame_id", place: str = "y * 37 + x * 101") -> str:
    """Count, sums and place-weighted sums of integer columns by key: alike only where the pixels are."""
    sums = ", ".join(f"CAST(sum(CAST({c} AS BIGINT)) AS BIGINT) AS {c}_sum, CAST(sum(CAST({c} AS BIGINT) * (({place}) % 97)) AS BIGINT) AS {c}_mix" for c in cols.split())
    return f"SELECT {keys}, count(*) AS n, {sums} FROM {rel} GROUP BY {keys}"
