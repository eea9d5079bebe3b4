"""URL filters: rules by host and path, and trust and distrust spread over the links between hosts.

Only DataFrame operations. Trusted hosts start a personalised PageRank along links; blocked hosts
start one against them, so that distrust reaches those who link to the blocked. Each host is judged
by the share of distrust in what has reached it.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .decontam import ascii_lower, if_small

DAMPING = 0.7
#: Least number of steps, and the number at which propagation gives up with a warning.
ITERATIONS, LIMIT = 16, 1000
#: Iterations between two written states.
STRIDE = 4
DISTRUST = 0.5
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits): for each distinct ``host`` with any, the rules (host, path, verdict) that hold
    for it or for a domain above it, longest first."""
    labels = F.split("host", r"\.")
    above = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )).alias("domain"))
    known = rules.select(
        F.col("host").alias("domain"), F.col("path").alias("from"), "verdict", F.concat("host", "path").alias("rule"),
    )
    fits = F.reverse(F.sort_array(F.collect_set(F.struct(F.length("rule").alias("size"), "rule", "from", "verdict"))))
    return above.join(if_small(known), "domain").groupBy("host").agg(fits.alias("fits"))


def host_links(pages: DataFrame, host_column: str = "host", source: str = "html") -> DataFrame:
    """(src, dst, n): absolute links from pages of one host to another host, counted."""
    linked = F.explode(F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(LINK), F.lit(1)))
    return (
        pages.select(F.col(host_column).alias("src"), linked.alias("dst")).withColumn("dst", ascii_lower(F.col("dst")))
        .where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    )


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS, distrust: float = DISTRUST) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    ``links``: (src, dst, n); ``seeds``: (host, trusted, blocked) flags. Both kinds of seeds share a
    mass of one. A step passes ``damping`` of a host's trust to the hosts it links to, and of its
    distrust to the hosts that link to it, by number of links; mass at a host without such links is
    not passed on. After ``iterations`` steps it goes on until no new host is reached and no host's
    share of distrust crosses ``distrust``. Without seeds there are no rows. Every step is one join and one sum that is
    combined before its shuffle.
    """
    out = links.groupBy(F.col("src").alias("__k")).agg(F.sum("n").alias("__n"))
    into = links.groupBy(F.col("dst").alias("__k")).agg(F.sum("n").alias("__n"))
    ways = stored(
        links.join(out, F.col("src") == F.col("__k")).select(
            F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("__n")).alias("wt"), F.lit(0.0).alias("wd"),
        ).union(links.join(into, F.col("dst") == F.col("__k")).select("dst", "src", F.lit(0.0), F.col("n") / F.col("__n"))), "links",
    )
    total = seeds.agg(F.sum(F.col("trusted").cast("long")), F.sum(F.col("blocked").cast("long"))).first()
    start = seeds.where("trusted or blocked").select(
        "host", (F.col("trusted").cast("double") / F.lit(float(total[0] or 1))).alias("trust"),
        (F.col("blocked").cast("double") / F.lit(float(total[1] or 1))).alias("distrust"),
    )
    start = stored(start, "seeds")
    state = before = start
    step, last = 0, None
    judged = F.col("distrust") > distrust * (F.col("trust") + F.col("distrust"))
    while True:
        step += 1
        moved = state.join(ways, "host").select(
            F.col("to").alias("host"), (damping * F.col("trust") * F.col("wt")).alias("trust"), (damping * F.col("distrust") * F.col("wd")).alias("distrust"),
        )
        fresh = start.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
        state = moved.union(fresh).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if step % STRIDE == 0:
            state = stored(state, "state")
            if before is not start:
                discard(before)
            before = state
            if step + STRIDE >= iterations:
                mark = state.agg(F.count("*"), F.bit_xor(F.xxhash64("host", judged))).first()
                if step >= iterations and mark == last:
                    return state
                last = mark
                if step >= LIMIT:
                    warnings.warn(f"hosts or verdicts still changed after {step} steps", stacklevel=2)
                    return state


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", source: str = "html", distrust: float = DISTRUST) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block), one row per row.

    The longest rule whose host is the url's or above it and whose path begins the url's decides;
    without one the host does: it is blocked if the share of distrust is over ``distrust``, and
    allowed otherwise, as are hosts that nothing reaches and urls without a host. Hosts are trusted
    (blocked) seeds if rules allow (block) more than half of their pages. Null urls and pages are
    empty; repeated rows count as often as they stand; input columns of the added names are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    bare = pages.select(
        *[F.col(c) for c in pages.columns if c not in added and c != source], *([F.col(source)] if source not in added else []),
    ).withColumn("host", host(F.col(url))).withColumn("path", path(F.col(url)))
    fits = if_small(stored(
        rules_of_hosts(bare.select("host").distinct(), rules).select(F.col("host").alias("__host"), F.to_json("fits").alias("__fits")), "fits",
    ))
    parsed = F.from_json("__fits", "array<struct<size:int,rule:string,from:string,verdict:string>>")
    best = F.try_element_at(F.filter(parsed, lambda r: F.startswith(F.col("path"), r["from"])), F.lit(1))

    def ruled(df: DataFrame) -> DataFrame:
        return df.join(fits, F.col("host") == F.col("__host"), "left").withColumn("__best", best).drop("__fits", "__host")

    counts = ruled(bare.select("host", "path")).groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("__best.verdict") == "allow").alias("a"), F.count_if(F.col("__best.verdict") == "block").alias("b"),
    )
    seeds = stored(counts.where("host <> ''").select("host", (2 * F.col("a") > F.col("n")).alias("trusted"), (2 * F.col("b") > F.col("n")).alias("blocked")), "hosts")
    scores = propagate(stored(host_links(bare, "host", source), "edges"), seeds, distrust=distrust)
    bad = scores.where(F.col("distrust") > distrust * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("__bad"))
    own = F.when(F.col("__bad").isNull(), F.lit("allow")).otherwise(F.lit("block"))
    return ruled(bare).join(if_small(stored(bad, "blocked")), F.col("host") == F.col("__bad"), "left").withColumn(
        "rule", F.col("__best.rule"),
    ).withColumn("verdict", F.coalesce("__best.verdict", own)).drop("__best", "__bad")
