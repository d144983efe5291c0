"""URL filters: allow and block rules, then logistic regression on hashed character n-grams of host and path.

All of it is DataFrame expressions and the DataFrame-based ML library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

FEATURES = 1 << 14
GRAMS = (3, 4, 5)
REGULARISATION = 1e-3
ITERATIONS = 60
#: Rules become one expression; more are refused.
MOST_RULES = 1000
#: Labelled rows that training takes at most.
MOST_LABELS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with all its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

# Words of the small labelled table (fixed values).
ALLOWED_WORDS = ("library", "university", "museum", "science", "weather", "history", "garden", "recipes", "archive", "journal", "school", "council")
BLOCKED_WORDS = ("casino", "poker", "viagra", "lottery", "jackpot", "escort", "xxx", "warez", "torrent", "payday", "pills", "betting")
PLAIN_WORDS = ("www", "blog", "m", "en", "de", "fr", "es", "index", "page", "item", "post", "view")


# Single labelled addresses, invented and judged by hand (fixed values): what a reader would want kept, and not.
ALLOWED_URLS = """
https://www.cityhall-norwood.example/departments/water/meter-reading.html
http://physics.lakeside-college.example/courses/optics/lecture-04.pdf
https://kitchen-notes.example/bread/sourdough-starter-day-three
http://birdwatchers.example/reports/2019/wetlands/
https://docs.gridlang.example/manual/en/closures.html
https://news.harbortimes.example/2021/06/ferry-timetable-changes
http://www.orchard-museum.example/exhibits/cider-press?lang=en
https://journal-of-soils.example/volume12/article7/abstract
https://travel.slowroads.example/norway/by-train/bergen
https://forum.bikefixers.example/thread/8831/rear-derailleur
http://villageschool.example/parents/term-dates
https://recipes.grandmas-table.example/soup/leek-and-potato
https://weather.highlands.example/forecast/weekend
https://maps.trailclub.example/routes/ridge-loop.gpx
http://library.oldtown.example/catalogue/search?author=woolf
https://blog.quiltmaker.example/patterns/log-cabin
https://health.county.example/vaccination/opening-hours
https://opera-archive.example/season/1987/programme
https://astronomy-evenings.example/meteor-shower-guide
http://www.railway-society.example/locomotives/class-47
https://dictionary.example/en/word/serendipity
https://gardeners-diary.example/april/pruning-roses
https://code.samplehost.example/projects/parser/issues/212
https://charity-run.example/results/half-marathon
http://theatre.example/whats-on/winter-tale
https://chess-club.example/games/annotated/round-5
https://economics.institute.example/papers/housing-supply
https://photos.family-album.example/holiday/lighthouse
https://lawreports.example/appeal/2004/contracts
https://museum-of-clocks.example/collection/pendulum
https://podcast.science-hour.example/episodes/deep-sea
https://language-exchange.example/meetups/spanish-evening
https://encyclopedia.example/wiki/Photosynthesis
http://farmers-market.example/stalls/honey
https://university-press.example/books/medieval-trade
https://swimming-pool.example/timetable/lanes
https://kids-crafts.example/paper/origami-crane
https://poetry-corner.example/poems/autumn
https://standards.example/specs/http/caching
https://observatory.example/data/sunspots.csv
""".split()
BLOCKED_URLS = """
http://freespins-now.example/slots/welcome-bonus-200
https://hot-singles-tonight.example/chat/register?aff=77
http://cheap-meds-online.example/buy/no-prescription
https://win-big-bets.example/sportsbook/odds-boost
http://cracked-soft.example/download/keygen-full-version.exe
https://adult-cams.example/live/private-show
http://quickcash-loans.example/apply/bad-credit-ok
https://crypto-doubler.example/deposit/bonus-now
http://xxxvideos-hub.example/category/amateur
https://replica-watches.example/rolex/discount-90
http://miracle-diet-pills.example/order/lose-20-pounds
https://bingo-jackpots.example/play/free-tickets
http://torrentz-mirror.example/movies/camrip-2020
https://get-followers-fast.example/buy/instagram-likes
http://poker-room-vip.example/rakeback/deposit
https://sexy-dates.example/join-free/age-18
http://viagra-express.example/checkout/generic
https://casino-royale-club.example/roulette/no-deposit
http://essay-cheaters.example/order/cheap-essay
https://prize-winner.example/claim/iphone-giveaway
http://nude-gallery.example/pics/teens
https://fake-id-shop.example/novelty/driver-license
http://betting-tips-vip.example/fixed-matches
https://payday-advance.example/instant/approval
http://warez-zone.example/apps/cracked/serial
https://slot-machines-online.example/real-money
http://escort-agency.example/city/girls
https://forex-robot.example/guaranteed-profit
http://spin-casino.example/vip-bonus/codes
https://lottery-syndicate.example/tickets/mega
http://adultfriend.example/hookup/near-you
https://steroid-store.example/buy/anabolic
http://phish-bank-login.example/verify/account-suspended
https://free-porn.example/video/hd
http://clickbait-prizes.example/survey/win-voucher
https://bet365-mirror.example/live/odds
http://hacked-accounts.example/netflix/free-login
https://gambling-portal.example/blackjack/strategy-bonus
http://cheap-cialis.example/pharmacy/online
https://hotgirls.example/webcam/free
""".split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``(url, label)``, 1 for block: each word of a kind in a host with each word of the kind in a path, over four suffixes, plain addresses, and the single ones."""
    suffixes, rows = ("com", "org", "net", "example"), []
    for kind, words in ((0, ALLOWED_WORDS), (1, BLOCKED_WORDS)):
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                end = suffixes[(i + j) % 4]
                rows.append((f"https://{a}{i * 7 + j}.{end}/{b}/{i * 31 + j}", kind))
                rows.append((f"http://www.{a}-{b}.{end}/{PLAIN_WORDS[(i + j) % 12]}/{j}.html", kind))
    for i, a in enumerate(PLAIN_WORDS):
        for j, b in enumerate(PLAIN_WORDS):
            rows.append((f"http://{a}.site{i * 12 + j}.{suffixes[(i + j) % 4]}/{b}/{i * 997 + j * 101}", 0))
    rows += [(u, 0) for u in ALLOWED_URLS] + [(u, 1) for u in BLOCKED_URLS]
    return spark.createDataFrame(rows, "url string, label int")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of an address; both empty for null and for addresses without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls. Of equally long ones the longer host, then the smaller text and verdict wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text, r.verdict), reverse=True):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _joined(mark: Column, shifted: list[Column]) -> Column:
    zipped = F.arrays_zip(*[x.alias(f"c{i}") for i, x in enumerate(shifted)])
    return F.transform(zipped, lambda z: F.concat(mark, *[z.getField(f"c{i}") for i in range(len(shifted))]))


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of both parts, marked with their part; ``^`` and ``$`` stand at the ends."""
    found = []
    for mark, part in (("h", host), ("p", path)):
        c = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        for n in GRAMS:
            found.append(_joined(F.lit(mark), [F.slice(c, i + 1, F.greatest(F.size(c) - (n - 1), F.lit(0))) for i in range(n)]))
    return F.concat(*found)


def train(labelled: DataFrame) -> PipelineModel:
    """The classifier from ``labelled(url, label)``: label 1 is to be blocked. Rows with null label don't count; at most MOST_LABELS rows are taken, in the order of their addresses."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = labelled.where("label is not null").orderBy("url", "label").limit(MOST_LABELS)
    rows = rows.select(grams(host, path).alias("__pw_grams"), F.col("label").cast("double").alias("__pw_label")).coalesce(1)
    hashed = HashingTF(numFeatures=FEATURES, inputCol="__pw_grams", outputCol="__pw_features", binary=True)
    model = LogisticRegression(featuresCol="__pw_features", labelCol="__pw_label", predictionCol="__pw_prediction", probabilityCol="__pw_probability", rawPredictionCol="__pw_raw", regParam=REGULARISATION, maxIter=ITERATIONS, standardization=False)
    return Pipeline(stages=[hashed, model]).fit(rows)


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row for each row of ``pages(page_id, url)``.

    A rule decides where one fits; elsewhere the classifier does. Null addresses and those without ``://``
    have empty parts, which fit no rule. Repeated rows are judged alike; an empty table stays empty.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("page_id", "host", "path", text.alias("rule"), verdict.alias("__pw_verdict"), grams(F.col("host"), F.col("path")).alias("__pw_grams"))
    scored = train(labelled).transform(ruled)
    by_model = F.when(F.col("__pw_prediction") == 1, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__pw_verdict", by_model).alias("verdict"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the address of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labelled_urls(spark))
