"""URL filters: rules for hosts and paths, and logistic regression on hashed character n-grams for the rest.

The labelled table names well-known hosts with a path of theirs: sites that a filter of training data lets through, and
sites of pornography, gambling, piracy, medicines without prescription, payday loans and fakes, which it blocks.  The
regression is a fold of gradient steps inside one row, over the n-grams of each URL and the URLs of each n-gram.  Its
weights are a literal of fixed size in the scoring expression, so scoring neither joins nor shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACES = 8192
STEPS, RATE, MOMENTUM, RIDGE = 60, 0.3, 0.9, 0.005
#: Chance from which a URL is blocked: with it, nine in ten of those blocked in cross-validation by host are rightly so.
CUT = 0.7

#: Well-known hosts, each with a path, that are let through.
ALLOWED = """
bbc.co.uk/news/world nytimes.com/section/technology theguardian.com/uk/culture reuters.com/markets lemonde.fr/planete spiegel.de/wissenschaft elpais.com/internacional washingtonpost.com/politics economist.com/leaders aljazeera.com/news
apnews.com/hub/science npr.org/sections/health cnn.com/travel zeit.de/kultur lefigaro.fr/sciences corriere.it/esteri asahi.com/articles abc.net.au/news cbc.ca/news timesofindia.com/business
mit.edu/research stanford.edu/admission ox.ac.uk/about cam.ac.uk/colleges harvard.edu/academics berkeley.edu/departments ethz.ch/en/studies uni-heidelberg.de/forschung sorbonne-universite.fr/formation u-tokyo.ac.jp/en
nasa.gov/missions noaa.gov/climate cdc.gov/flu nih.gov/research loc.gov/collections europa.eu/policies who.int/publications un.org/en/about gov.uk/browse/driving usgs.gov/programs
github.com/topics/compiler gitlab.com/explore stackoverflow.com/questions/tagged/python python.org/downloads kernel.org/doc debian.org/releases mozilla.org/firefox apache.org/foundation gnu.org/software postgresql.org/docs
amazon.com/books ebay.com/motors etsy.com/shop walmart.com/grocery target.com/home ikea.com/furniture homedepot.com/tools bestbuy.com/laptops zalando.de/herren otto.de/moebel
booking.com/hotels expedia.com/flights tripadvisor.com/restaurants airbnb.com/rooms lufthansa.com/booking sncf.com/horaires bahn.de/fahrplan kayak.com/cars marriott.com/offers hilton.com/locations
imdb.com/title rottentomatoes.com/movies spotify.com/album soundcloud.com/discover goodreads.com/book gutenberg.org/ebooks archive.org/details allrecipes.com/recipe epicurious.com/ingredients seriouseats.com/baking
webmd.com/allergies mayoclinic.org/diseases healthline.com/nutrition sciencemag.org/journals arxiv.org/abs pubmed.gov/articles jstor.org/stable springer.com/journals elsevier.com/authors britannica.com/topic
merriam-webster.com/dictionary dictionary.com/browse duolingo.com/course khanacademy.org/math coursera.org/learn edx.org/course ted.com/talks medium.com/story wordpress.com/themes blogger.com/features
espn.com/soccer fifa.com/rankings nba.com/standings olympics.com/athletes uefa.com/fixtures skysports.com/cricket kicker.de/bundesliga marca.com/futbol strava.com/routes rei.com/hiking
""".split()  # fmt: skip
#: Well-known hosts, each with a path, that are blocked.
BLOCKED = """
pornhub.com/categories xvideos.com/tags xhamster.com/videos xnxx.com/search redtube.com/hot youporn.com/browse tube8.com/latest spankbang.com/trending eporner.com/cat brazzers.com/pornstars
chaturbate.com/female-cams livejasmin.com/girls bongacams.com/couples stripchat.com/trans myfreecams.com/models cam4.com/male camsoda.com/private adultfriendfinder.com/swingers ashleymadison.com/affair onlyfans.com/nudes
playboy.com/playmates hustler.com/hardcore penthouse.com/pets bangbros.com/scenes realitykings.com/milf naughtyamerica.com/sex literotica.com/stories sexstories.com/incest porntube.com/amateur pornmd.com/fetish
bet365.com/sports betfair.com/exchange williamhill.com/betting ladbrokes.com/odds unibet.com/live-betting betway.com/slots bwin.com/wetten 1xbet.com/bonus betano.com/apostas sportingbet.com/bets
pokerstars.com/poker partypoker.com/tournaments fulltiltpoker.com/freeroll 888poker.com/download ggpoker.com/holdem 888casino.com/roulette casino.com/blackjack leovegas.com/jackpots mrgreen.com/casino royalpanda.com/free-spins
thepiratebay.org/torrent 1337x.to/popular rarbg.to/torrents kickasstorrents.to/movies yts.mx/torrent-download extratorrent.cc/warez torrentz2.eu/search limetorrents.info/keygen fitgirl-repacks.site/crack skidrowreloaded.com/cracked
canadianpharmacy.com/viagra viagra.com/buy-online cialis.com/discount-pills rxpills.net/levitra buyxanax.com/no-prescription pharmacyexpress.com/cheap-viagra edpills.com/generic-cialis steroids.com/anabolic buysteroids.com/dianabol onlinepharmacy.net/tramadol
paydayloans.com/apply cashadvance.com/payday moneymutual.com/instant-loan speedycash.com/title-loans acecashexpress.com/payday-loan replicawatches.com/rolex fakeids.com/order essaymill.com/buy-essay rolexreplica.net/cheap-watches louisvuittonreplica.com/handbags
freebitco.in/doubler doublemybitcoin.com/invest getrichquick.com/bonus clickbank.com/offers popads.net/popunder propellerads.com/popups adfly.com/skip-ad exoclick.com/banner trafficjunky.com/ads juicyads.com/adzone
""".split()  # fmt: skip


def labelled() -> list[tuple[str, int]]:
    """The table's URLs (1: block): each host as ``www.`` at its root, as itself with its path, and, in turn, with a mobile
    or language prefix, a query or a number behind the path, and a host named by the first and last word of its path; the
    forms are the same for both classes."""
    out = []
    for label, rows in ((0, ALLOWED), (1, BLOCKED)):
        for i, row in enumerate(rows):
            host, _, path = row.partition("/")
            more = (f"http://m.{host}/{path}", f"https://en.{host}/{path}?page=2", f"https://{host}/{path}/{i * 7919 % 9973}", f"http://{host}/index.html")[i % 4]
            out += [(f"https://www.{host}/", label), (f"https://{host}/{path}", label), (more, label)]
            words = [w for w in re.split("[^a-z]+", path.lower()) if len(w) > 3]
            if words and path.isascii() and not re.search("[0-9]", path):
                out.append((f"https://www.{''.join(dict.fromkeys((words[0], words[-1])))}.com/", label))
    return out


#: Fixed values: (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def grams(host: Column, path: Column) -> Column:
    """The distinct places of the character 3- and 4-grams of ``^host$`` and of ``^path$``; what a path teaches holds for
    names of hosts too."""

    def runs(codes: Column, k: int) -> Column:
        at = F.when(F.size(codes) >= k, F.sequence(F.lit(0), F.size(codes) - k)).otherwise(F.array().cast("array<int>"))
        code = lambda i: sum((F.get(codes, i + j) * 131**j for j in range(k)), F.lit(7919 + k * 104729).cast("long"))
        return F.transform(at, lambda i: F.pmod(F.pmod(code(i), F.lit(1000003)) * 31, F.lit(PLACES)).cast("int"))

    def places(text: Column) -> Column:
        codes = F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c).cast("long"))
        # inside a lambda the codes are a variable, computed once for all n-grams
        bound = F.transform(F.array(F.filter(codes, lambda c: c > 0)), lambda c: F.concat(runs(c, 3), runs(c, 4)))
        return F.get(bound, F.lit(0))

    return F.array_distinct(F.concat(places(host), places(path)))


def fit(spark: SparkSession, table: list[tuple[str, int]] | None = None) -> list[float]:
    """Weights of the places, and the intercept last.

    ``table`` is small (by default some four URLs of each named host): its n-grams, and for each place the URLs that have it, are held in one row.
    Every step moves all weights at once by the mean slope of the log likelihood, less the ridge, and by a share of the
    step before.
    """
    table = labelled() if table is None else table
    rows = spark.createDataFrame([(i, u, float(y)) for i, (u, y) in enumerate(table)], "r int, url string, y double")
    host, path = split_url(F.col("url"))
    rows = rows.select("r", "y", grams(host, path).alias("g"))
    has = rows.select("r", F.explode("g").alias("p")).groupBy("p").agg(F.collect_list("r").alias("rs"))
    has = spark.range(PLACES).select(F.col("id").cast("int").alias("p")).join(has, "p", "left").select(F.struct("p", F.coalesce("rs", F.array().cast("array<int>")).alias("rs")).alias("e"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("r", "y", "g"))).alias("t")).crossJoin(has.agg(F.array_sort(F.collect_list("e")).alias("has")))  # one row each
    zeros = F.transform("has", lambda e: F.lit(0.0))
    start = F.struct(zeros.alias("w"), zeros.alias("v"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"))
    n = float(max(1, len(table)))
    total = lambda items, of: F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))

    def step(state: Column, _: Column) -> Column:
        left = F.transform("t", lambda u: u["y"] - 1.0 / (1.0 + F.exp(-(state["b"] + total(u["g"], lambda p: F.get(state["w"], p))))))

        def moved(r: Column) -> Column:
            slope = F.zip_with(state["w"], F.col("has"), lambda w, e: total(e["rs"], lambda i: F.get(r, i)) / n - RIDGE * w)
            v = F.zip_with(state["v"], slope, lambda v, x: MOMENTUM * v + RATE * x)
            return F.struct(v.alias("v"), (MOMENTUM * state["c"] + RATE * total(r, lambda x: x) / n).alias("c"))

        def added(m: Column) -> Column:
            return F.struct(F.zip_with(state["w"], m["v"], lambda w, v: w + v).alias("w"), m["v"].alias("v"), (state["b"] + m["c"]).alias("b"), m["c"].alias("c"))

        bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  inside a lambda x is computed once
        return bound(bound(left, moved), added)

    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("m")).first().m
    return [round(x, 9) for x in [*found.w, found.b]]


def chance(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that a URL is to be blocked."""
    w = F.split(F.lit(",".join(map(repr, weights[:-1]))), ",").cast("array<double>")  # folded to one literal
    z = F.aggregate(grams(host, path), F.lit(weights[-1]), lambda s, p: s + F.get(w, p))
    return 1.0 / (1.0 + F.exp(-z))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of rules of one length that whose text comes first.
    ``rules`` is a short list that is tried in full."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits)


def judge(pages: DataFrame, weights: list[float] | None = None, rules=RULES, cut: float = CUT) -> DataFrame:
    """Every row of ``pages(page_id, url)`` with host, path, rule, verdict and the model's block_chance.

    Null URLs and those without ``://`` have an empty host and path and are judged like any other; long URLs are taken
    whole, repeated rows are judged alike, extra columns are ignored.
    """
    weights = weights or fit(pages.sparkSession)
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = parts.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("r"), chance(F.col("host"), F.col("path"), weights).alias("block_chance"))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("block_chance") >= cut, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "block_chance")
