"""Exact and look-alike duplicates of a batch against the catalog and itself.

Rows have seq (a total order: catalog first, then the batch), path, sha256 and perceptual (64 bits as a bigint). The
answer of the one-by-one loop has a closed form in that order: a row is *exact* if an earlier row has its sha256, and
matches the first such; else it is *near* the closest earlier row that is no exact duplicate itself, within a
threshold, ties to the earliest. Null digests never match.
"""

from __future__ import annotations

from itertools import combinations
from math import comb, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumibase.functions import origin
from lumibase.functions.measures import hamming
from lumibase.operators.stages import written


def size_prefilter(batch: DataFrame, known_sizes: DataFrame) -> DataFrame:
    """A10: whether a size occurs twice in the batch or in the catalog, so that its content has to be read. Sizes are
    counted before the join, so that a size which a third of all files have stays one row."""
    counted = batch.groupBy("size").agg(F.count("*").alias("n"))
    known = known_sizes.select("size").distinct().withColumn("known", F.lit(True))
    shared = counted.join(known, "size", "left").where((F.col("n") > 1) | F.col("known")).select("size", F.lit(True).alias("shared"))
    return batch.join(shared, "size", "left").withColumn("needs_hash", F.coalesce("shared", F.lit(False))).drop("shared")


def exact_matches(rows: DataFrame) -> DataFrame:
    """Adds kind (exact or null), and seq and path of the first row with the same content. The first is found by
    aggregation and joined back, which splits a content that very many rows have."""
    first = rows.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("seq", "path")).alias("f"))
    joined = rows.join(first, "sha256", "left")
    again = F.col("f.seq") < F.col("seq")
    return joined.select(*(F.col(c) for c in rows.columns), F.when(again, "exact").alias("kind"), F.when(again, F.col("f.seq")).alias("match_seq"), F.when(again, F.col("f.path")).alias("match_path"))


def pieces(threshold: int, agree: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """The 64 bits in ``threshold + agree`` pieces (first bit, end), and all choices of ``agree`` of them: two signatures
    within the threshold differ in at most so many pieces, and so are equal on one choice at least."""
    if not 0 <= threshold <= 8:
        raise ValueError("thresholds from 0 to 8 have pieces that tell signatures apart")
    count = threshold + agree
    edges = [64 * k // count for k in range(count + 1)]
    return list(zip(edges, edges[1:], strict=False)), list(combinations(range(count), agree))


#: A key is shuffled and sorted, while a comparison is an exclusive or and a count of bits: so many of these cost less.
COMPARED_PER_KEY = 32


def cheapest_agree(threshold: int, signatures: int) -> int:
    """How many pieces have to agree so that keys and compared pairs cost least for so many signatures. More of them
    make more keys, each of more bits."""
    cost = lambda agree: comb(threshold + agree, agree) * (1 + signatures / 2.0 ** (64 * agree / (threshold + agree)) / COMPARED_PER_KEY)
    return min(range(1, 7), key=cost)


def bands(signature: Column, threshold: int, agree: int = 1) -> Column:
    """The keys (band, value) of a signature: each choice of pieces with their bits."""
    spans, choices = pieces(threshold, agree)

    def value(choice: tuple[int, ...]) -> Column:
        bits = F.lit(0).cast("long")
        for a, b in (spans[n] for n in choice):
            own = F.shiftrightunsigned(signature, a)
            bits = F.shiftleft(bits, b - a).bitwiseOR(own if b - a == 64 else own.bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return bits

    return F.array(*(F.struct(F.lit(k).alias("band"), value(choice).alias("value")) for k, choice in enumerate(choices)))


#: Up to this radius pieces are chosen that agree as a whole; beyond it, up to the most, pieces may differ a little.
MOST_AGREEING, MOST_RADIUS = 8, 15


def _dealt(signatures: DataFrame, rows: int, keys: int) -> DataFrame:
    """Signatures dealt over tasks by what they become: each so many keys, which Spark, that goes by the bytes of the
    table, would leave to one task."""
    return signatures.repartition(max(signatures.sparkSession.sparkContext.defaultParallelism, rows * keys // 1_000_000), "perceptual")


def signature_links(signatures: DataFrame, threshold: int, agree: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of different signatures within the threshold, in both orders. Each signature occurs once
    in the input, which is read several times, so it should be a written table. Keys are chosen by the number of
    signatures, so that they stay selective as the table grows; which they are changes no pair."""
    if threshold > MOST_AGREEING:
        pairs = flipped_pairs(signatures, threshold)
        return pairs.where(hamming(F.col("a"), F.col("b")) <= threshold).select("a", "b", hamming(F.col("a"), F.col("b")).alias("distance"))
    n = signatures.count()
    agree = agree or cheapest_agree(threshold, n)
    banded = _dealt(signatures, n, comb(threshold + agree, agree)).select(F.col("perceptual").alias("sig"), F.explode(bands(F.col("perceptual"), threshold, agree)).alias("p")).select("sig", "p.band", F.xxhash64("p.band", "p.value").alias("key"))
    # one long to sort by; keys that are equal by chance have no pair, as its first choice has to be the band of both
    a, b = banded.alias("a"), banded.alias("b")
    pairs = a.join(b.hint("merge"), F.col("a.key") == F.col("b.key")).where((F.col("a.sig") < F.col("b.sig")) & (hamming(F.col("a.sig"), F.col("b.sig")) <= threshold))
    spans, choices = pieces(threshold, agree)
    differ = F.col("a.sig").bitwiseXOR(F.col("b.sig"))
    mask = lambda choice: sum(((1 << (b - a)) - 1) << a for a, b in (spans[n] for n in choice))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    agreed = F.array_position(F.transform(F.array(*(F.lit(signed(mask(c))) for c in choices)), lambda m: differ.bitwiseAND(m) == 0), F.lit(True)) - 1
    first = pairs.where(agreed == F.when(F.col("a.band") == F.col("b.band"), F.col("a.band")))  # named once, or Spark finds it for all that are compared
    both = F.array(F.struct(F.col("a.sig").alias("a"), F.col("b.sig").alias("b")), F.struct(F.col("b.sig").alias("a"), F.col("a.sig").alias("b")))
    return first.select(F.explode(both).alias("p")).select("p.a", "p.b", hamming(F.col("p.a"), F.col("p.b")).alias("distance"))


def radii(threshold: int, count: int) -> list[int]:
    """How far each of so many pieces may differ: two signatures within the threshold are within one piece's radius at
    least, for else the pieces' distances would add up to more. With T = count * r + a, the first a + 1 pieces have the
    radius r and the others r - 1."""
    r, a = divmod(threshold, count)
    return [r] * (a + 1) + [r - 1] * (count - a - 1)


def flips(bits: int, radius: int) -> list[int]:
    """All numbers of so many bits of which at most ``radius`` are set."""
    return [sum(1 << n for n in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def cheapest_pieces(threshold: int, signatures: int, most_flips: int = 2000) -> int:
    """In how many pieces to cut, so that probes and compared pairs are fewest for so many signatures."""

    def cost(count: int) -> float:
        sizes = [64 * (k + 1) // count - 64 * k // count for k in range(count)]
        probes = [sum(comb(size, n) for n in range(radius + 1)) for size, radius in zip(sizes, radii(threshold, count), strict=True)]
        return inf if max(probes) > most_flips else sum(p * (1 + signatures / 2.0**size) for p, size in zip(probes, sizes, strict=True))

    return min(range(2, 9), key=cost)


def flipped_pairs(signatures: DataFrame, threshold: int, count: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of different signatures that are within a piece's radius: b lies in the index under each of
    its pieces, and a looks up all flips of each of its own. A pair comes from the first such piece alone."""
    if not 0 <= threshold <= MOST_RADIUS:
        raise ValueError(f"radii from 0 to {MOST_RADIUS} can be searched")
    n = signatures.count()
    count = count or cheapest_pieces(threshold, n)
    edges = [64 * k // count for k in range(count + 1)]
    near = radii(threshold, count)

    def piece(signature: Column, k: int) -> Column:
        return F.shiftrightunsigned(signature, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))

    own = F.col("perceptual")
    index = signatures.select(own.alias("b"), F.explode(F.array(*(F.struct(F.lit(k).alias("piece"), piece(own, k).alias("value")) for k in range(count)))).alias("p")).select("b", "p.piece", "p.value")

    def looked_up(k: int) -> Column:
        masks = F.array(*(F.lit(m).cast("long") for m in flips(edges[k + 1] - edges[k], near[k])))
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("piece"), piece(own, k).bitwiseXOR(m).alias("value")))

    per_row = sum(len(flips(edges[k + 1] - edges[k], near[k])) for k in range(count))
    probes = _dealt(signatures, n, per_row).select(own.alias("a"), F.explode(F.concat(*map(looked_up, range(count)))).alias("p")).select("a", "p.piece", "p.value")
    found = probes.join(index, ["piece", "value"]).where("a <> b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    fits = F.array(*(F.bit_count(piece(differ, k)) <= near[k] for k in range(count)))
    return found.where(F.array_position(fits, F.lit(True)) - 1 == F.col("piece")).select("a", "b")


def near_matches(rows: DataFrame, threshold: int = 5) -> DataFrame:
    """For rows that are no exact duplicates (kind null), the nearest earlier row of these: near_seq, near_path and
    distance. Signatures are compared once each, however many rows have them; of the rows with a signature the first
    one is the earliest for all. The rows are read several times, so they should be a written table, and so are the
    different signatures."""
    own = rows.where("kind IS NULL AND perceptual IS NOT NULL").select("seq", "path", "perceptual")
    first = written(own.groupBy("perceptual").agg(F.min(F.struct("seq", "path")).alias("first")), "signatures")
    links = signature_links(first, threshold).join(first.select(F.col("perceptual").alias("b"), "first"), "b")
    # a signature's own first row is a link of distance 0
    near = links.select("a", "distance", "first").unionByName(first.select(F.col("perceptual").alias("a"), F.lit(0).alias("distance"), "first"))
    other = own.join(near, F.col("perceptual") == F.col("a")).where(F.col("first.seq") < F.col("seq"))
    other = other.select("seq", F.struct(F.col("distance"), F.col("first.seq").alias("near_seq"), F.col("first.path").alias("near_path")).alias("m"))
    best = other.groupBy("seq").agg(F.min("m").alias("m")).select("seq", "m.*")
    return rows.join(best, "seq", "left")


def scope_to_destination(resolved: DataFrame, copies: DataFrame | None, drive: str | None) -> DataFrame:
    """A catalog match only counts if the drive has that content; the path is then the copy's. Without a scope
    (None, unlike a drive with no copies) everything stays. ``match_origin`` says where the matched row came from."""
    if copies is None or drive is None:
        return resolved
    held = copies.where(F.col("drive_uuid") == drive).select("sha256", F.col("relative").alias("held_path")).dropDuplicates(["sha256"])
    joined = resolved.join(held, "sha256", "left")
    lost = (F.col("kind") == "exact") & (F.col("match_origin") == "catalog") & F.col("held_path").isNull()
    moved = (F.col("kind") == "exact") & (F.col("match_origin") == "catalog") & F.col("held_path").isNotNull()
    return joined.withColumns({
        "kind": F.when(~F.coalesce(lost, F.lit(False)), F.col("kind")),
        "match_path": F.when(moved, F.col("held_path")).when(~F.coalesce(lost, F.lit(False)), F.col("match_path")),
        "match_origin": F.when(~F.coalesce(lost, F.lit(False)), F.col("match_origin")),
    }).drop("held_path")


def resolve(catalog: DataFrame, batch: DataFrame, threshold: int = 5, *, perceptual: bool = True) -> DataFrame:
    """K1: the batch's rows with kind (exact, near, unique), match_path, match_origin and distance. Both inputs have
    path, sha256, perceptual; their order is by path."""
    order = lambda df, n: df.select("path", "sha256", "perceptual", F.lit(n).alias("part"))
    rows = order(catalog, 0).union(order(batch, 1)).withColumn("seq", F.struct("part", "path"))
    found = exact_matches(rows)
    if perceptual:
        found = near_matches(written(found, "exact"), threshold)
    else:
        found = found.withColumns({"near_seq": F.lit(None).cast(found.schema["seq"].dataType), "near_path": F.lit(None).cast("string"), "distance": F.lit(None).cast("int")})
    matched = F.coalesce("match_seq", "near_seq")
    kind = F.when(F.col("kind") == "exact", "exact").when(F.col("near_path").isNotNull(), "near").otherwise("unique")
    part = F.when(matched["part"] == 0, "catalog").when(matched["part"] == 1, "batch")
    return found.where("part = 1").select("path", "sha256", kind.alias("kind"), F.coalesce("match_path", "near_path").alias("match_path"), part.alias("match_origin"), F.when(kind == "near", F.col("distance")).alias("distance"))


# Formats whose look is slow to compute, and the share of images from which on that is worth saying.
SLOW_FORMATS = ("heic", "heif", "hif")
SLOW_SHARE = 0.25


def forecast(batch: DataFrame, name: Column) -> DataFrame:
    """What finding exact duplicates has to read (files that share a size, their bytes and the share of all bytes),
    and how many of the images are slow to compare."""
    image = F.coalesce(origin.media_kind(name) == "image", F.lit(False))
    slow = image & origin.extension(name).isin(*SLOW_FORMATS)
    sizes = batch.groupBy("size").agg(F.count("*").alias("n"), F.count_if(image).alias("images"), F.count_if(slow).alias("slow"))
    shared = (F.col("n") > 1) & F.col("size").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = sizes.agg(
        total("n").alias("files"), total(F.col("n") * F.col("size")).alias("bytes"),
        total(F.when(shared, F.col("n"))).alias("colliding_files"), total(F.when(shared, F.col("n") * F.col("size"))).alias("colliding_bytes"),
        total("images").alias("images"), total("slow").alias("slow_images"),
    )
    part = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    shares = totals.withColumns({"share": part("colliding_bytes", "bytes"), "slow_share": part("slow_images", "images")})
    return shares.withColumn("slow_look", F.col("slow_share") >= SLOW_SHARE)


def duplicate_bytes(resolved: DataFrame) -> DataFrame:
    """Only exact duplicates can be freed; look-alikes are only counted. A missing size is a file without bytes."""
    total = lambda kind, what: F.coalesce(F.sum(F.when(F.col("kind") == kind, what)), F.lit(0))
    return resolved.agg(
        total("exact", F.lit(1)).alias("exact_files"), total("exact", F.col("size")).alias("reclaimable_bytes"),
        total("near", F.lit(1)).alias("near_files"), total("near", F.col("size")).alias("near_bytes"),
    )


def report_buckets(resolved: DataFrame, *, skip_undated: bool = False) -> DataFrame:
    """Disjoint buckets (unreadable, exact, near, unique) that sum to the total, and what will be organized."""
    bucket = F.when(F.col("sha256").isNull(), "unreadable").otherwise(F.col("kind"))
    goes = (bucket == "unique") | (bucket == "near")
    if skip_undated:
        goes = goes & F.col("captured_at").isNotNull()
    return resolved.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("files"), F.count_if(goes).alias("will_organize"))


def split_by_origin(resolved: DataFrame) -> DataFrame:
    """Exact duplicates by where the match came from."""
    return resolved.where("kind = 'exact'").groupBy(F.coalesce("match_origin", F.lit("unclassified")).alias("origin")).agg(F.count("*").alias("files"))


def planned_actions(resolved: DataFrame, *, skip_undated: bool = False) -> DataFrame:
    """What a run would do, by label."""
    undated = F.col("captured_at").isNull() if skip_undated else F.lit(False)
    action = F.when(F.col("kind") == "exact", "duplicate").when(undated, "skipped_undated").otherwise("planned")
    return resolved.groupBy(action.alias("action"), "category").agg(F.count("*").alias("files"))


def uncompared_photos(rows: DataFrame, kind: Column, sample: int = 20) -> DataFrame:
    """Images that were read, and tried, and whose look could not be computed: the first by path, and the total."""
    failed = rows.where((kind == "image") & F.col("sha256").isNotNull() & F.col("perceptual_computed") & F.col("perceptual").isNull())
    total = failed.agg(F.count("*").alias("total")).withColumn("k", F.lit(0))
    return failed.orderBy("path").limit(sample).select("path", F.lit(0).alias("k")).join(total, "k").drop("k")


def write_candidates(resolved: DataFrame, limit: int, *, skip_undated: bool = False) -> DataFrame:
    """What a run would write: files, bytes, and those over the target's limit for a file."""
    goes = F.col("kind") != "exact"
    if skip_undated:
        goes = goes & F.col("captured_at").isNotNull()
    return resolved.where(goes).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("size") > limit).alias("oversized"))


def folder_groups(listing: DataFrame, folder: Column, first: int = 20) -> DataFrame:
    """T5: the first folders with their files, and how many folders there are."""
    groups = listing.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"))
    total = groups.agg(F.count("*").alias("folders")).withColumn("k", F.lit(0))
    return groups.orderBy(F.desc("files"), "folder").limit(first).withColumn("k", F.lit(0)).join(total, "k").drop("k")


def preflight(need: DataFrame, free_bytes: int | None) -> DataFrame:
    """Whether what A30 would write fits; room that could not be measured counts as enough."""
    return need.withColumn("fits", (F.lit(True) if free_bytes is None else F.col("bytes") <= free_bytes) & (F.col("oversized") == 0))
