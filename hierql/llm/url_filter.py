"""URL filters: explicit rules first, then logistic regression on hashed n-grams.

The classifier sees character n-grams of host and path, each hashed with its
part's name into a fixed number of slots, and is trained from a small labelled
table of URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, prepare

BITS = 18
#: Labelled URLs to start from, by kind of site; a caller may give its own table.
UNWANTED = """casino-royal.test/play grand-casino.test/slots casinos.test/bonus casino-games.test/live mycasino.test/ casino.test/join casinoplay.test/en poker-room.test/play poker-bonus.test/ roulette.test/table blackjack.test/ jackpot.test/spin slots-online.test/spin lotto-numbers.test/
bets.test/odds live-bets.test/today sports-betting.test/live bet-exchange.test/ bookmaker.test/odds wager.test/ gambling.test/bonus
pills.test/buy diet-pills.test/offer pills-shop.test/order meds-online.test/shop viagra.test/buy cialis.test/order cheap-pharmacy.test/ no-prescription.test/buy cheap-tramadol.test/
adserver.test/track ads-network.test/banner ad-clicks.test/click tracker.test/pixel click-tracker.test/r popup-ads.test/ banner-exchange.test/show tracking-pixel.test/ doubleads.test/serve
spam.test/post spammer.test/links link-exchange.test/seo buy-backlinks.test/ seo-links.test/rank doorway-pages.test/ spam-mail.test/list bulk-mail.test/send
adult-cams.test/live adult.test/free adult-video.test/ porn-tube.test/video xxx.test/gallery sex-cams.test/ escorts.test/city nude-pics.test/ x-rated.test/video
free-money.test/now free-prizes.test/claim get-rich.test/quick payday-loans.test/apply replica-watches.test/sale fake-designer.test/bags crack-keygen.test/download warez.test/crack torrent-cracks.test/ miracle-cure.test/""".split()
WANTED = """university.test/research library.test/catalog museum.test/exhibit news.test/politics daily.test/article gazette.test/world weather.test/forecast tribune.test/opinion
school.test/courses college.test/admissions science.test/journal health.test/advice hospital.test/patients city.test/services county.test/records parish.test/register
garden.test/plants kitchen.test/recipes travel.test/guides maps.test/route train.test/timetable music.test/concerts theatre.test/season cinema.test/reviews opera.test/tickets
writer.test/post history.test/archive sports.test/results wiki.test/page software.test/manual photography.test/thread books.test/list poetry.test/verse letters.test/edition
parliament.test/debates court.test/rulings bank.test/accounts insurance.test/claims energy.test/tariffs water.test/quality air.test/measurements space.test/missions senate.test/votes
thread.test/needle leather.test/shoes feather.test/bird northern.test/lights southern.test/cross another.test/day together.test/home mother.test/child brother.test/music
station.test/platform nation.test/people table.test/chairs stable.test/horses mountain.test/trail river.test/boats forest.test/walks meadow.test/flowers island.test/ferry harbour.test/ships
lantern.test/light winter.test/snow summer.test/camp autumn.test/leaves spring.test/water bridge.test/toll castle.test/tour village.test/market hotel.test/rooms tavern.test/menu
engine.test/parts bicycle.test/repair tractor.test/dealers furniture.test/oak clothing.test/sizes pottery.test/glaze carpenter.test/tools painter.test/brushes printing.test/press
mathematics.test/proof physics.test/lecture chemistry.test/table biology.test/cells geology.test/rocks astronomy.test/stars linguistics.test/grammar philosophy.test/essay economics.test/trade
archive.test/box catalogue.test/entry dictionary.test/word atlas.test/country almanac.test/year chronicle.test/age journal.test/volume review.test/issue bulletin.test/notice
thing.test/shop wheel.test/rim shell.test/beach earth.test/soil heart.test/clinic breath.test/yoga truth.test/essay worth.test/value growth.test/report width.test/units
otter.test/pond heron.test/lake raven.test/tower robin.test/nest terrier.test/puppy heather.test/moor ether.test/paper tenor.test/aria sonnet.test/line tonic.test/drink
server-docs.test/install tracker-birds.test/species betony.test/herb alphabet.test/letters advice.test/legal address.test/book clicker-dogs.test/training doors.test/glass awards.test/essay
growers.test/market cottage.test/stay freedom.test/press freeway.test/traffic mill.test/visit expert.test/opinion context.test/notes textile.test/weave""".split()
#: Weight of a clean row of the table beside an unwanted one: most URLs are clean.
CLEAN_WEIGHT = 2.0
_FACTORS = mix64(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot): the distinct hashed character 3- to 5-grams of hosts and paths, by row."""
    n = len(hosts)
    texts = [f"^{t}$" for t in (*hosts, *paths)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found = []
    for k in (3, 4, 5):
        if len(points) < k:
            continue
        hashes = np.zeros(len(points) - k + 1, np.uint64)
        for i in range(k):
            hashes += points[i : len(points) - k + 1 + i] * _FACTORS[i]
        whole = owner[: len(hashes)] == owner[k - 1 :]
        own, hashes = owner[: len(hashes)][whole], hashes[whole]
        part = (own >= n).astype(np.uint64)
        slot = (mix64(hashes + part * np.uint64(8) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        found.append((own % n << BITS) | slot)
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probabilities that URLs are unwanted; 0 where host and path are empty."""
        if not len(hosts):
            return np.zeros(0)
        row, slot = grams(hosts, paths)
        counts = np.bincount(row, minlength=len(hosts))
        z = np.bincount(row, weights=self.weights[slot], minlength=len(hosts)) / np.sqrt(np.maximum(counts, 1)) + self.bias
        there = np.fromiter((bool(h or p) for h, p in zip(hosts, paths, strict=True)), bool, len(hosts))
        return np.where(there, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def variants(url: str) -> list[str]:
    """A table entry under several prefixes, suffixes and paths, which so carry no weight of their own."""
    name, _, path = url.partition("/")
    name = name.removesuffix(".test")
    return [f"{name}.com/{path}", f"www.{name}.net/en/{len(url)}7.html", f"m.{name}.example.com/de/{len(name)}41", f"blog.{name}.example.org/{path}", f"{name}.example.net/fr/{len(path)}36/"]


def train(labelled: list[tuple[str, int]] | None = None, steps: int = 300) -> UrlModel:
    """Logistic regression from (host/path, unwanted) pairs; by default the table above."""
    table = [(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED]
    rows = labelled if labelled is not None else [(v, label) for u, label in table for v in variants(u)]
    split = [u.partition("/") for u, _ in rows]
    row, column = grams([h for h, _, _ in split], [s + p for _, s, p in split])
    y = np.array([label for _, label in rows], float)
    importance = np.where(y == 1, 1.0, CLEAN_WEIGHT)
    importance /= importance.sum()
    value = 1 / np.sqrt(np.bincount(row, minlength=len(rows)))[row]
    w, b, m, v = np.zeros(1 << BITS), 0.0, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[column] * value, minlength=len(rows)) + b
        error = (1 / (1 + np.exp(-z)) - y) * importance
        g = np.append(np.bincount(column, weights=error[row] * value, minlength=1 << BITS) + 1e-5 * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - d[:-1], b - d[-1]
    return UrlModel(w.astype(np.float32), float(b))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, else null.

    A rule fits its host and all subdomains, if the path starts with the
    rule's; of equally long ones the first by text wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=False):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], model: UrlModel, url_col: str = "url", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (default: all) plus host, path, rule, verdict and score.

    The verdict is the longest fitting rule's, else ``block`` from the
    threshold on.  Only URLs without a rule are scored, others have a null
    score.  A null URL or one without ``://`` has an empty host and path and is
    allowed.  Rows stay as they are, repeated ones too; kept columns with the
    names of new ones are replaced.
    """
    prepare(pages.sparkSession, rows=4096)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    new = ("host", "path", "rule", "verdict", "score")
    kept = [c for c in (keep if keep is not None else pages.columns) if c not in new]
    host, path = split_url(F.col(f"`{url_col}`"))

    @F.pandas_udf(T.DoubleType())
    def unwanted(hosts, paths):
        import pandas as pd

        out = np.full(len(hosts), np.nan)
        open_rows = hosts.notna().to_numpy()
        out[open_rows] = shared.value.scores(hosts[open_rows].tolist(), paths[open_rows].tolist())
        return pd.Series(out)

    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("hq_none")).alias("hq_row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hq_rule", matching_rule(F.col("host"), F.col("path"), rules))
    free = [F.when(F.col("hq_rule").isNull(), F.col(c)) for c in ("host", "path")]
    rows = rows.withColumn("score", F.nanvl(unwanted(*free), F.lit(None).cast("double")))
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(*[F.col(f"hq_row.`{c}`") for c in kept], "host", "path", F.col("hq_rule.rule").alias("rule"), F.coalesce(F.col("hq_rule.verdict"), own).alias("verdict"), "score")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, train(), keep=["page_id"])
