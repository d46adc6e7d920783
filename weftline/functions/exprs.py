"""Column expressions that the operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sRGB matrix, a row for each of X, Y and Z, and the white point (D65).
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE_POINT = (0.95047, 1.0, 1.08883)


def hash_percent(key: Column, seed: str) -> Column:
    """A key's place in 0..99: the first eight hex digits of md5("seed:key"), modulo 100."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_of(key: Column, seed: str = "split-v1", train: int = 80, val: int = 10) -> Column:
    p = hash_percent(key, seed)
    return F.when(p < train, "train").when(p < train + val, "val").otherwise("test")


def seed_of(*parts: Column) -> Column:
    """The first 16 hex digits of sha256 over the parts joined by |, as decimal(20,0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double; null if either is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """v at length 1; null for a vector of zeros, which has no direction."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def vector_sum(vectors: Column, size: int) -> Column:
    """The sum of an array of vectors, place by place."""
    return F.aggregate(vectors, F.array_repeat(F.lit(0.0), size), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))


def rescaled(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k of n; null for n = 0."""
    p, zz = k / n, z * z
    middle, reach = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low, high = ((middle - reach) / (1 + zz / n), (middle + reach) / (1 + zz / n))
    return F.when(n > 0, F.greatest(low, F.lit(0.0))), F.when(n > 0, F.least(high, F.lit(1.0)))


def quantile_at(ordered: Column, p: Column) -> Column:
    """Linear interpolation at share p in a sorted array, p varying by row; null for an empty array."""
    place = p * (F.size(ordered) - 1)
    below = F.floor(place)
    at = lambda i: F.element_at(ordered, F.least(i.cast("int") + 1, F.size(ordered)))
    return F.when(F.size(ordered) > 0, at(below) + (at(below + 1) - at(below)) * (place - below))


def to_step(x: Column, step: float) -> Column:
    """x rounded half to even to a multiple of step."""
    return F.bround(x / step) * step


def signed_round(x: Column, digits: int) -> Column:
    """round() that keeps the sign of what becomes zero, as SQL engines that round in binary do: -0.00001 gives -0.0."""
    near = F.round(x, digits)
    return F.when(near == 0, x * 0.0).otherwise(near)


def set_key(ids: Column) -> Column:
    """One key for a set of ids, in whatever order they come."""
    return F.array_join(F.array_sort(ids), "|")


def largest_remainder(shares: Column, target: Column) -> Column:
    """Whole numbers that sum to target, nearest to shares: floors, and one more for the largest remainders, first first."""
    spare = target.cast("int") - F.aggregate(F.transform(shares, lambda x: F.floor(x).cast("int")), F.lit(0), lambda s, x: s + x)
    order = F.array_sort(F.transform(shares, lambda x, i: F.struct((F.floor(x) - x).alias("r"), i.alias("i"))))
    place = F.transform(shares, lambda _, i: F.array_position(F.transform(order, lambda o: o["i"]), i))
    return F.zip_with(shares, place, lambda x, at: F.floor(x).cast("int") + F.when(at <= spare, 1).otherwise(0))


def largest_remainders(shares: list[Column], target: Column) -> list[Column]:
    """largest_remainder() of a few columns, without lambdas: each column's place is told by comparing it with the others."""
    whole = [F.floor(x).cast("int") for x in shares]
    left = [x - w for x, w in zip(shares, whole, strict=True)]
    spare = target.cast("int") - sum(whole[1:], whole[0])
    ahead = lambda i, j: (left[j] >= left[i] if j < i else left[j] > left[i]).cast("int")
    places = [sum((ahead(i, j) for j in range(len(shares)) if j != i), F.lit(1)) for i in range(len(shares))]
    return [w + F.when(at <= spare, 1).otherwise(0) for w, at in zip(whole, places, strict=True)]


def looked_up(value: Column, table: Mapping[str, str | float]) -> Column:
    """A small dictionary as an expression; null for what it lacks."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value]


def pair_low(a: Column, b: Column) -> Column:
    return F.least(a, b)


def pair_high(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(a: str, b: str, names: list[str]) -> Column:
    """Whether two sides agree in all names, unknown agreeing with unknown."""
    out = F.lit(True)
    for n in names:
        out &= F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`"))
    return out


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda s, x: s + x))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII text, as a long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    modulus = F.lit(1 << 32)
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619).cast("long"), modulus))


def lab_of(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of an sRGB colour of 0 to 255."""

    def linear(c: Column) -> Column:
        x = c / 255.0
        return F.when(x > 0.04045, F.pow((x + 0.055) / 1.055, F.lit(2.4))).otherwise(x / 12.92)

    r, g, b = linear(red), linear(green), linear(blue)
    xyz = [sum((w * c for w, c in zip(row, (r, g, b), strict=True)), F.lit(0.0)) / white for row, white in zip(SRGB_TO_XYZ, WHITE_POINT, strict=True)]
    x, y, z = (F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)
