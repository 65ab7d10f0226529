"""URL filter: domain rules, and for other URLs a logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

#: (verdict, host, path): the rule fits the host and its subdomains if the path starts as given.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BUCKETS, GRAMS = 1 << 16, (3, 4, 5)

#: The words of which the labelled table's names are made. What belongs to gambling, pornography, unprescribed drugs, quick
#: credit, fakes, piracy, tracking and fraud is blocked.
BLOCKED = """
    casino poker slots slot bet bets betting roulette jackpot blackjack lotto lottery baccarat wager gamble spins bingo sportsbook odds
    porn porno xxx sex sexy adult nude nudes cams webcam escort escorts milf hentai hookup singles hot dating erotic fetish naked
    viagra cialis levitra pills pill pharmacy meds xanax tramadol steroids slimming weightloss keto detox enlargement cannabis vape
    loan loans payday credit cash debt forex crypto bitcoin profit invest doubler earn income rich money payout refinance
    replica fake rolex handbags knockoff outlet cheap discount bargain deals free win winner prize prizes bonus gift giveaway reward
    torrent warez crack cracked keygen serial nulled pirate streamz unlocker hack cheats generator
    ads adserver track tracker click clicks popup banner affiliate promo traffic spam spammer phish verify-account login-update unlock
""".split()
ALLOWED = """
    library university college school academy faculty museum gallery archive theatre orchestra choir festival
    news daily times herald gazette journal review magazine press bulletin weekly radio
    weather climate ocean river mountain forest garden flower bird fish farm harvest nature planet geology
    cooking kitchen recipe bakery bread cheese coffee tea wine soup restaurant
    travel guide map atlas railway airport harbor hotel hostel camping hiking cycling
    history science physics chemistry biology mathematics astronomy medicine nursing clinic hospital dental
    council city town village county parliament ministry court police fire embassy
    football tennis rowing chess swimming athletics club team league stadium
    software compiler database network kernel python docs wiki forum blog editor browser cloud
    books novel poetry writer reading language grammar dictionary translation
    music guitar piano violin jazz opera studio film cinema photo camera painting pottery
    family children parents teacher student pension insurance bank tax law notary energy water
""".split()
#: Hosts as they are, whose names hold words of the other kind or look like it, and the best known of either kind.
KNOWN_ALLOWED = """
    wikipedia.org github.com stackoverflow.com nytimes.com theguardian.com bbc.co.uk lemonde.fr spiegel.de elpais.com
    arxiv.org nature.com who.int nasa.gov mit.edu ox.ac.uk essex.ac.uk sussex.ac.uk middlesex.gov.uk freecodecamp.org
    freebsd.org freelancer.com credit-suisse.com creditkarma.com betterhealth.vic.gov.au bettercotton.org betterment.com
    hotmail.com hotels.com hotwire.com windows.com winchester.ac.uk winnipeg.ca wintershall.de darwin.museum godwin.net
    clickhouse.com tracker.debian.org bugtracker.org tracksmith.com cashmere.org cashel.ie profiteroles.fr pillsbury.com
    pillow.readthedocs.io slotermeer.nl slotcar.org betanews.com alphabet.com elizabeth.org tibet.net diabetes.org
    adulteducation.gov adultlearning.org therapists.org expertsexchange.com cocktails.net loanwords.org porntip.go.th
    richmond.gov.uk ostrich.org debtadvice.org.uk bonusbooks.org giftedchildren.org crackers.net crackle.com pokerface.org
    camera.org camden.gov.uk webcamgalore.org dealership.net discountstore.org escortforum.ford.com spamassassin.apache.org
""".split()
KNOWN_BLOCKED = """
    pornhub.com xvideos.com xnxx.com xhamster.com redtube.com youporn.com chaturbate.com onlyfans-leaks.com brazzers.com
    bet365.com betway.com 888casino.com pokerstars.com partypoker.com williamhill.com unibet.com bwin.com 1xbet.com
    slotomania.com jackpotcity.com leovegas.com 22bet.com stake.com ladbrokes.com pinnacle-bets.net onlinebetting.top
    doubleclick.net popads.net propellerads.com adsterra.com exoclick.com trafficjunky.com outbrain-ads.net taboola-ads.net
    canadianpharmacy.win viagraonline.net buycialis.top cheapmeds.xyz pharmacy-rx.club paydayloansnow.com quickcash.win
    fastcashadvance.com thepiratebay.org 1337x.to torrentz2.eu keygenz.net nulled.to crackstreams.biz replicawatches.cn
    cheaprolex.top hotsingles.club meetsexy.date adultfriendfinder.com iphonewinner.xyz freegiftcards.top claimprize.win
    crypto-doubler.io bitcoinprofit.top paypal-verify-account.com appleid-login-update.info secure-bank-unlock.xyz
""".split()
#: Beginnings, middles and ends of the syllables of made-up names, which say nothing and are allowed.
ONSETS, VOWELS, CODAS = "b c d f g h j k l m n p r s t v w th st sh tr gr wh".split(), "a e i o u ea ou io".split(), ["", "", "", "n", "r", "l", "s", "st", "nd", "ng", "ble"]
#: What URLs of either kind end in, and what only blocked ones may.
PATHS, SPAM_PATHS = ["/", "", "/about", "/archive/2019/04", "/en/771", "/fr/82.html", "/de/5/", "/es/4033", "/en/12/", "/article/economy"], ["/play", "/signup/now", "/bonus", "/go/buy"]
ENDINGS, SPAM_ENDINGS = ["com", "net", "org", "example.com", "example.net", "example.org", "co.uk", "de"], ["xyz", "top", "win", "club"]
PREFIXES = ["", "www.", "m.", "blog.", "shop."]


def names(seed: int = 8, each: int = 3, without: frozenset[str] = frozenset()) -> list[tuple[str, int]]:
    """(name, 1 for block): each word alone and beside `each` others of its kind, joined by a hyphen, a number or not at all.

    Words of `without` are held out.
    """
    rng = np.random.default_rng(seed)
    out = []
    for every, y in ((BLOCKED, 1), (ALLOWED, 0)):
        words = [w for w in every if w not in without]
        for w in words:
            out.append((w, y))
            for k, i in enumerate(rng.integers(0, len(words), each).tolist()):
                out.append((w + ["-", "", str(rng.integers(1, 999))][k % 3] + (words[i] if k % 3 < 2 else ""), y))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    for _ in range(20 * len(ALLOWED)):
        out.append(("".join(pick(ONSETS) + pick(VOWELS) + pick(CODAS) for _ in range(rng.integers(1, 4))), 0))
    return out


def labelled(seed: int = 8, without: frozenset[str] = frozenset()) -> list[tuple[str, str, int]]:
    """(host, path, 1 for block): every name under a prefix, an ending and a path, which mostly say nothing; known hosts."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    some = lambda y, xs, spam: pick(spam if y and rng.random() < 0.2 else xs)
    known = [(pick(("", "www.")) + h, pick(PATHS), y) for hosts, y in ((KNOWN_BLOCKED, 1), (KNOWN_ALLOWED, 0)) for h in hosts for _ in range(2)]
    return known + [(f"{pick(PREFIXES)}{n}.{some(y, ENDINGS, SPAM_ENDINGS)}", some(y, PATHS, SPAM_PATHS), y) for n, y in names(seed, without=without) for _ in range(2)]


@cache
def weights() -> np.ndarray:
    """The weights of the whole labelled table, trained once in a process."""
    return train(labelled())


def grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct n-grams of ^host$ and of path, bytewise, all rows at once."""
    found = [np.zeros(0, np.int64)]
    for part, texts in enumerate(([f"^{h}$" for h in hosts], paths)):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(len(raw)), [len(t) for t in raw])
        code = np.zeros(len(data), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            size = len(data) - n + 1
            if size < 1:
                break
            code = code[:size] << np.uint64(8) | data[n - 1 :]
            if n in GRAMS:
                inside = row[:size] == row[n - 1 :]
                bucket = mix(code[inside] + np.uint64((8 * part + n) << 48)) % np.uint64(BUCKETS)
                found.append(row[:size][inside] * BUCKETS + bucket.astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both // BUCKETS, both % BUCKETS


def train(table: list[tuple[str, str, int]], rounds: int = 300, rate: float = 0.3, l2: float = 1e-6) -> np.ndarray:
    """Weights (the last is the bias) by gradient descent over the whole labelled table, each kind counting half of it.

    Steps of a weight shrink with the squares of its gradients so far; the result is the same on every run.
    """
    y = np.array([t for _, _, t in table], float)
    at, col = grams([h for h, _, _ in table], [p for _, p, _ in table])
    x = 1 / np.sqrt(np.maximum(1, np.bincount(at, minlength=len(y))))
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-12)
    for _ in range(rounds):
        z = np.bincount(at, w[col], len(y)) * x + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) * share
        step = np.append(np.bincount(col, (g * x)[at], BUCKETS) + l2 * w[:-1], g.sum())
        seen += step * step
        w -= rate * step / np.sqrt(seen)
    return w


def scores(w: np.ndarray, hosts: list[str], paths: list[str]) -> np.ndarray:
    """The probability that each URL should be blocked."""
    at, col = grams(hosts, paths)
    x = np.sqrt(np.maximum(1, np.bincount(at, minlength=len(hosts))))
    return 1 / (1 + np.exp(-(np.bincount(at, w[col], len(hosts)) / x + w[-1])))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(pages: DataFrame, weights: np.ndarray, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.6, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule (null if none fits), verdict, score (null with a rule).

    The longest fitting rule decides; the classifier judges what no rule fits, null and empty urls included. Rows that
    repeat are judged alike; an empty table gives no rows; other columns, page texts too, are never read.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, verdicts = (batch.column(i).to_pylist() for i in (1, 2, 4))
            open_ = [i for i, v in enumerate(verdicts) if v is None]
            found: list[float | None] = [None] * len(batch)
            for i, s in zip(open_, scores(weights, [hosts[i] for i in open_], [paths[i] for i in open_]).tolist(), strict=True):
                found[i], verdicts[i] = s, "block" if s >= threshold else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(found, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), weights()).drop("score")
