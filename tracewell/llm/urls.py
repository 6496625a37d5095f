"""URL filter: domain and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import map_batches, unused

#: The labelled table: addresses without scheme and query. Wanted ones are pages of well-known public sites; unwanted ones are made up in the manner of
#: public block lists (gambling, adult, drug sales, lending, piracy, counterfeits, trackers, phishing, link selling).
WANTED = """
en.wikipedia.org/wiki/Photosynthesis
de.wikipedia.org/wiki/Eisenbahn
fr.wikipedia.org/wiki/Montagne
es.wikipedia.org/wiki/Historia_de_la_ciencia
en.wiktionary.org/wiki/harvest
commons.wikimedia.org/wiki/Category:Bridges
www.gutenberg.org/ebooks/search
archive.org/details/texts
www.bbc.co.uk/news/science_and_environment
www.theguardian.com/books/reviews
www.nytimes.com/section/world
www.reuters.com/world/europe
apnews.com/hub/climate
www.lemonde.fr/culture
www.spiegel.de/wissenschaft
elpais.com/ciencia
www.nature.com/articles
www.science.org/journal/science
arxiv.org/abs/math
pubmed.ncbi.nlm.nih.gov/about
www.nasa.gov/missions/station
www.noaa.gov/weather
www.usgs.gov/programs/earthquake-hazards
www.loc.gov/collections
www.mit.edu/education
www.stanford.edu/research
www.ox.ac.uk/admissions/undergraduate
www.cam.ac.uk/study-at-cambridge
ocw.mit.edu/courses/mathematics
www.khanacademy.org/science/biology
www.coursera.org/browse/data-science
github.com/apache/spark
docs.python.org/tutorial/index.html
docs.oracle.com/javase/tutorial
developer.mozilla.org/docs/Web/HTML
stackoverflow.com/questions/tagged/java
www.kernel.org/doc/html/latest
www.apache.org/foundation/how-it-works.html
www.postgresql.org/docs/current/index.html
www.debian.org/releases/stable
www.gnu.org/software/bash/manual
www.w3.org/standards/webdesign
www.rust-lang.org/learn
go.dev/doc/effective_go
spark.apache.org/docs/latest/sql-programming-guide.html
www.metmuseum.org/art/collection
www.louvre.fr/collections
www.britishmuseum.org/exhibitions
www.smithsonianmag.com/history
www.nationalgeographic.com/animals/mammals
www.britannica.com/place/Alps
www.dictionary.com/browse/gentle
www.goodreads.com/list/popular
www.allrecipes.com/recipes/bread
www.seriouseats.com/how-to-roast-vegetables
www.bbcgoodfood.com/recipes/collection/soup
www.gardenersworld.com/plants
www.rhs.org.uk/advice/grow-your-own
www.weather.gov/forecastmaps
www.metoffice.gov.uk/research
www.who.int/health-topics/vaccines
www.nhs.uk/conditions/asthma
www.mayoclinic.org/diseases-conditions
www.cdc.gov/handwashing
www.un.org/sustainabledevelopment
europa.eu/youreurope/citizens
www.gov.uk/renew-passport
www.service-public.fr/particuliers
www.bundestag.de/parlament
www.openstreetmap.org/about
www.lonelyplanet.com/italy/rome
www.tripadvisor.com/Tourism
www.olympics.com/sports/rowing
www.fifa.com/tournaments
www.imdb.com/chart/top
www.rottentomatoes.com/browse/movies
www.discogs.com/genre/jazz
www.classicfm.com/composers
www.poetryfoundation.org/poems
www.instructables.com/woodworking
www.ifixit.com/Guide
www.etsy.com/market/ceramics
www.ikea.com/rooms/kitchen
www.fao.org/forestry
www.worldbank.org/topic/education
www.imf.org/publications
www.ecb.europa.eu/stats
www.economist.com/finance-and-economics
www.chess.com/lessons
www.scientificamerican.com/space
phys.org/physics-news
www.quantamagazine.org/mathematics
news.ycombinator.com/newest
lists.debian.org/debian-user
medium.com/topic/writing
www.wikihow.com/Tie-a-Knot
www.npr.org/sections/music
www.pbs.org/wgbh/nova
www.openculture.com/freeonlinecourses
plato.stanford.edu/entries/logic
""".split()
UNWANTED = """
luckycasinobonus.top/signup
royal-casino-slots.biz/jackpot
casinospinsnow.info/bonus-codes
pokerroomvip.net/deposit-bonus
realmoney-poker.club/tables
slotmachinesfree.xyz/play-slots
sportsbetting-tips.bet/odds-today
betting-odds-live.info/football-bets
bet365mirror.win/betting
mega-jackpot-lottery.top/claim-prize
lottowinners.click/you-won
xxxvideoshd.tube/porn-videos
freepornmovies.xxx/hardcore
hotsexcams.live/cam-girls
adultdatingfinder.com/hookup
adultvideos-online.net/xxx/amateur
nudegirls-gallery.com/sex-pics
escort-services-city.com/escorts
sexychatroom.club/adult-chat
milfdating.top/sex-dating
buyviagraonline.biz/viagra-no-prescription
cialis-generic-pharmacy.com/order-cialis
canadianpharmacyrx.top/pills/buy-now
weightlosspills-fast.info/diet-pills
xanax-without-prescription.net/buy-pills-online
steroids4sale.biz/shop/steroids
replicawatches-outlet.com/replica-rolex
fakedesignerbags.store/replica-handbags
cheap-oakley-outlet.top/cheap-sunglasses
louis-replica-shop.biz/cheap-bags
payday-loans-instant.biz/cash-advance
fastcashloans.info/apply-loan-now
badcreditloans-approved.com/quick-loan
debtrelief-offers.click/free-quote
makemoneyfast-online.biz/earn-money
getrichquick-system.info/free-money
workfromhome-cash.top/easy-money
forexsignals-profit.club/guaranteed-profit
bitcoin-doubler.xyz/double-your-coins
crypto-giveaway-elon.top/claim-bonus
warezdownload.cc/crack-keygen
cracked-software.ru/serial-keygen-download
torrentmovies-free.to/download-full-movie
keygen-serials.info/cracks
freemp3downloads.click/free-download
pirated-games.xyz/crack-download
popunder-ads.net/adserver/click.php
adserver-tracking.info/banner-ads
clicktracker-network.com/track/click
banner-exchange-ads.biz/ads/popup
adclick-affiliate.top/affiliate-offers
pixel-tracker-ads.click/adtrack
paypal-account-verify.top/login-secure-update
appleid-verify-login.xyz/account-suspended
bank-secure-login.click/verify-account
netflix-billing-update.info/confirm-payment
free-iphone-winner.top/claim-your-prize
giftcard-generator.club/free-gift-cards
survey-rewards.win/free-gift
you-are-a-winner.click/prize-claim
buybacklinks-cheap.com/seo-links
link-exchange-directory.biz/submit-link
seo-spam-blast.info/cheap-backlinks
buyfollowers-likes.top/cheap-followers
article-spinner-seo.net/spam-content
guestpost-links.biz/buy-links
www.forum-archive.net/casino-bonus
blog.handmade-goods.com/buy-viagra-cheap
www.cityguide.info/poker-online
photos.family-album.net/porn-pics
www.schoolclub.org/cheap-pills-online
news.localpaper.net/payday-loan-offers
wiki.gamers.org/free-spins-casino
www.villagehall.co.uk/replica-watches
old.choir.org/sex-cams-live
shop.oldtown.com/online-betting-bonus
""".split()

#: From here on the hosts of UNWANTED are innocent, and their paths alone are unwanted.
FIRST_INNOCENT = "www.forum-archive.net/casino-bonus"

RULES: tuple[tuple[str, str], ...] = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def training_table() -> list[tuple[str, str, int]]:
    """(host, path, label), label 1 for unwanted: each address as it stands, and wanted and unwanted hosts with the paths of wanted pages,
    so that a host is judged by itself, and neutral paths carry no label."""
    split = lambda address: ("/" + address).split("/", 2)[1:]
    wanted, unwanted = [split(a) for a in WANTED], [split(a) for a in UNWANTED]
    rows = [(host, "/" + path, 0) for host, path in wanted] + [(host, "/" + path, 1) for host, path in unwanted]
    paths = ["/", *("/" + path for _, path in wanted)]
    innocent = {split(a)[0] for a in UNWANTED[UNWANTED.index(FIRST_INNOCENT) :]}
    for label, hosts in ((0, [host for host, _ in wanted]), (1, [host for host, _ in unwanted])):
        for i, host in enumerate(hosts):
            rows += [(host, p, label if host not in innocent else 0) for p in ("/", *(paths[(i * 7 + j) % len(paths)] for j in (0, 31, 62)))]
    for i, (_, path) in enumerate(unwanted):
        rows += [(wanted[(i * 5 + j) % len(wanted)][0], "/" + path, 1) for j in (0, 41)]
    return rows


def features(host: str, path: str, bits: int = 18, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Distinct hashed character n-grams of host (without a leading www.) and path, each in its own name space; digits are all read as 0."""
    found = set()
    for kind, s in (("h", f"^{host.removeprefix('www.')}$"), ("p", f"^{path}$")):
        s = "".join("0" if c.isdigit() else c for c in s)
        for n in sizes:
            for i in range(len(s) - n + 1):
                found.add(zlib.crc32(f"{kind}{s[i : i + n]}".encode("utf-8", "surrogatepass")) & ((1 << bits) - 1))
    return np.fromiter(sorted(found), dtype=np.int64, count=len(found))


class UrlModel:
    """Weights over 2**bits hashed n-grams; features of a URL are weighted 1 / sqrt(their number). The bias is the log-odds of the
    share of unwanted pages that is expected before anything is read, so an address without learned n-grams scores that share."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int):
        self.weights, self.bias, self.bits = weights, bias, bits

    @classmethod
    def train(cls, rows: list[tuple[str, str, int]], bits: int = 18, steps: int = 150, rate: float = 0.1, decay: float = 5e-5, prior: float = 0.1) -> UrlModel:
        """Adam on the log loss of all rows at once: the same table gives the same weights."""
        seen = [features(h, p, bits) for h, p, _ in rows]
        labels, sizes = np.array([y for *_, y in rows], dtype=np.float64), np.array([len(x) for x in seen], dtype=np.int64)
        bias = float(np.log(prior / (1 - prior)))
        if not sizes.sum():
            return cls(np.zeros(1 << bits, np.float32), bias, bits)
        used, column = np.unique(np.concatenate(seen), return_inverse=True)
        row = np.repeat(np.arange(len(rows)), sizes)
        value = 1 / np.sqrt(np.maximum(1, sizes))[row]
        w, first, second = (np.zeros(len(used)) for _ in range(3))
        for t in range(1, steps + 1):
            z = np.bincount(row, weights=w[column] * value, minlength=len(rows)) + bias
            error = 1 / (1 + np.exp(-z)) - labels
            gradient = np.bincount(column, weights=error[row] * value, minlength=len(used)) / len(rows) + decay * w
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weights = np.zeros(1 << bits, np.float32)
        weights[used] = w
        return cls(weights, bias, bits)

    def score(self, host: str, path: str) -> float:
        x = features(host, path, self.bits)
        return float(1 / (1 + np.exp(-(self.weights[x].sum() / np.sqrt(max(1, len(x))) + self.bias))))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end with A-Z lower-cased, path then up to ? or #; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits `host` and `path`, else nulls."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in reversed(ranked):
        domain, _, tail = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, model: UrlModel | None = None, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """pages with host, path, rule, score (null where a rule decides) and verdict.

    Defined results: a null url or one without :// has empty host and path, so no rule fits and the model scores the
    empty strings; repeated rows get a row each; input columns named host, path, rule, score or verdict are replaced.
    """
    model = model or UrlModel.train(training_table())
    names = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in names]
    ruled_by = unused([*kept, *names], "__verdict")
    host, path = split_url(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    cut = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(rules)
    ruled = cut.withColumn("rule", rule).withColumn(ruled_by, verdict)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}
        for batch in batches:
            scores = []
            for h, p, v in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), batch.column(ruled_by).to_pylist()):
                if v is not None:
                    scores.append(None)
                    continue
                key = (h, "".join("0" if c.isdigit() else c for c in p))
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = model.score(h, p)
                scores.append(known[key])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in ruled.schema), "score double"])
    scored = map_batches(ruled, run, schema)
    return scored.withColumn("verdict", F.coalesce(F.col(ruled_by), F.when(F.col("score") >= threshold, "block").otherwise("allow"))).drop(ruled_by)
