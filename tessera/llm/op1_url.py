"""URL filter: logistic regression on hashed character n-grams of host and path, beneath exact rules.

Everything is native. The features of a URL are the hashed 3- and 4-grams of ``^host$`` and of its
path, digits folded to 0, each present or not, scaled to unit length. Training is full-batch gradient
descent as one SQL expression over the small labelled table: examples and the postings of each hash
bucket are two arrays of one row, and ``aggregate`` folds the steps. The weights (``BUCKETS`` + 1
doubles) are a literal of the scoring plan, which reads only page_id and url and has no shuffle.

Rules come first: a rule (host and path prefix) fits its host and all subdomains of it if the path
starts with the rule's; the longest rule that fits decides, else the model does.

Defined cases: a url that is null or has no ``://`` has empty host and path, fits no rule, and gets
the model's verdict for empty strings; repeated rows are judged alike; an empty table gives an empty
result; labelled rows with a null are left out; with no labelled rows the model allows everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table

BUCKETS, GRAMS = 1024, (3, 4)
STEPS, RATE, DECAY = 120, 0.5, 0.0005
#: Labelled rows that the fit may use: those with the smallest hashes, if there are more.
MOST_LABELLED = 5000

#: The rules (verdict, rule) of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: A small labelled URL table, one for each verdict.
ALLOWED = """
https://www.citylibrary.org/catalogue/history/maps
https://docs.openmaths.org/en/guide/linear-algebra
https://news.riverpost.com/world/2021/04/12/election-results
https://blog.gardenhome.net/posts/2019/growing-tomatoes
https://en.encyclopedia.org/wiki/Photosynthesis
https://www.university.edu/research/papers/climate
https://museum.example.org/collections/ancient-pottery
https://www.cooking-school.com/recipes/bread/sourdough
https://support.softwarehouse.com/articles/install-on-linux
https://www.healthservice.gov/advice/vaccines
https://forum.photographers.net/topic/12034/lenses
https://learn.codeacademy.org/python/lesson/4
https://www.parliament.gov/bills/2020/education
https://journal.biology.org/volume/12/issue/3/article
https://travelnotes.net/fr/paris/musees
https://www.weather.gov/forecast/region/south
https://archive.newspapers.org/1998/06/02/front-page
https://tutorials.webdesign.com/css/flexbox
https://www.orchestra.org/programme/season/spring
https://m.sportdaily.com/football/match-report/2210
https://www.science-magazine.com/features/black-holes
https://blog.teachers.net/reading/classroom-ideas
https://www.bookshop.com/reviews/novels/2017
https://wiki.linuxusers.org/index/kernel-modules
https://www.philosophy.edu/courses/ethics/notes
https://de.encyclopedia.org/wiki/Bundestag
https://es.encyclopedia.org/wiki/Fotosintesis
https://fr.encyclopedia.org/wiki/Revolution
https://www.farmersweekly.com/articles/soil-health
https://docs.database.org/manual/queries/joins
https://www.chess-club.net/openings/sicilian
https://www.hospital.org/patients/visiting-hours
https://blog.mountains.com/trails/2018/alpine-hut
https://www.courts.gov/opinions/2015/case-112
https://stories.childrensbooks.org/tales/the-fox
https://www.astronomy.edu/observatory/telescope
https://news.villagepaper.net/local/school-fair
https://www.engineering.org/standards/bridges
https://music.theory.net/lessons/harmony
https://www.history.edu/archives/letters/1862
https://help.mailservice.com/faq/forwarding
https://www.birdwatching.org/species/heron
https://www.theatre.net/reviews/hamlet
https://www.economics.edu/papers/inflation
https://open.lectures.org/physics/mechanics/week-2
https://www.carpentry.com/guides/dovetail-joint
https://www.language-learning.net/german/grammar/cases
https://kitchen.example.com/en/31002
https://orchard.example.net/de/204/
https://blog.meadow.example.org/fr/20110.html
https://m.harbour.example.com/es/731
https://history-notes.example.net/en/40121
https://railway.example.org/de/5512
https://the-valley.example.com/fr/900/
https://station.example.net/es/1245
https://m.readers.example.org/en/388.html
https://blog.weather.example.net/fr/77
https://northern.example.com/de/6210
https://lanterns.example.org/es/4410/
""".split()
BLOCKED = """
https://www.casino-bonus-777.com/free-spins/jackpot
https://best-slots-online.net/casino/win-big-money
https://cheap-pills-store.biz/buy-viagra-cialis-online
https://hot-xxx-cams.com/adult/live-sex-chat
https://free-porn-videos.xxx/watch/teen
https://poker-bonus.win/casino/no-deposit-bonus
https://www.sexdating4u.com/adult/hookup-tonight
https://replica-watches-cheap.com/buy-now/discount-rolex
https://payday-loans-fast.biz/apply/cash-now
https://crypto-doubler.top/free-bitcoin/claim-now
https://win-iphone-free.click/survey/prize-claim
https://cheap-meds-rx.biz/order/no-prescription-pills
https://betting-tips-win.com/casino/sure-odds
https://xxx-tube-free.net/porn/hd-videos
https://essay-writing-cheap.biz/buy-essay-online
https://download-crack-keygen.net/warez/full-version
https://free-movies-torrent.click/download/full-hd
https://get-followers-fast.top/buy-instagram-likes
https://adult-cams-live.xxx/sex/webcam
https://lucky-jackpot-casino.win/spin/bonus
https://buy-cheap-viagra.biz/pills/discount
https://make-money-fast.top/earn/cash-from-home
https://escort-girls.xxx/adult/book-now
https://online-poker-slots.biz/play/free-bonus
https://forex-profit-now.click/signal/win-money
https://www.nude-pics-free.com/xxx/gallery
https://warez-crack.top/download/serial-keygen
https://cheap-replica-bags.biz/discount/buy-online
https://sex-chat-free.click/adult/join
https://weight-loss-pills.biz/buy/miracle-diet
https://casino-royal-bonus.click/slots/free-spins
https://bet-365-win.top/betting/bonus-code
https://porn-hub-free.click/xxx/watch-now
https://free-gift-cards.win/claim/prize
https://loan-no-credit-check.biz/cash/apply-now
https://hacked-accounts.top/download/premium-free
https://cam-girls-xxx.win/live/sex
https://discount-cialis.click/order/pills-online
https://jackpot-slots.top/casino/play-now
https://click-here-win.click/prize/claim-free
https://seo-backlinks-cheap.biz/buy-links
https://pirated-software.click/crack/download-free
https://adult-toys-sexshop.xxx/buy-now/discount
https://bitcoin-casino.win/bonus/free-spins
https://keygen-serial.biz/warez/crack
https://dating-hot-singles.top/adult/meet-tonight
https://free-money-claim.win/cash/prize
https://viagra-online.top/cheap/buy-pills
https://xxx-movies.click/porn/download
https://bonus-betting.biz/casino/odds-win
https://casino-spins.example.net/de/310
https://m.winbig-casino.example.org/en/5120
https://adult-video.example.com/fr/88/
https://blog.xxx-adult.example.net/es/4501
https://pills-cheap.example.org/en/702
https://cheap-meds.example.com/de/2200.html
https://free-betting.example.net/es/19
https://m.bets-online.example.com/en/6104
https://spammy-links.example.org/fr/3311
https://linkfarm-spam.example.net/de/118/
https://ads-server.example.com/en/47
https://tracking-ads.example.org/es/905
""".split()


def host_of(url):
    rest = F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)", 2)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def features(host, path, buckets: int = BUCKETS, grams=GRAMS):
    """Distinct hash buckets of the n-grams of host and path; never empty, for the end marks count."""

    def hashed(tag, text, n):
        text = F.translate(F.concat(F.lit("^"), text, F.lit("$")), "0123456789", "0" * 10)
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        gram = lambda i: F.concat(F.lit(f"{tag}{n}"), F.substring(text, i, F.lit(n)))
        # the first 32 bits of the MD5, which SQL elsewhere has too
        return F.transform(places, lambda i: F.pmod(F.conv(F.substring(F.md5(gram(i).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))

    return F.array_distinct(F.concat(*[hashed(tag, text, n) for tag, text in (("h", host), ("p", path)) for n in grams]))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: (url, label), 1 for blocked."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for y, urls in ((0, ALLOWED), (1, BLOCKED)) for u in urls]
    return spark.range(1).select(F.inline(F.array(*rows)))


def fit(labelled: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY, most: int = MOST_LABELLED) -> list[float]:
    """Weights by bucket, then the bias, from (url, label). At most ``most`` rows, by the hash of the url."""
    rows = labelled.filter("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("url"), "url", "label").limit(most)
    rows = rows.select("*", (F.row_number().over(Window.orderBy(F.xxhash64("url"), "url", "label")) - 1).alias("i"))
    rows = rows.select("i", "label", features(host_of(F.col("url")), path_of(F.col("url")), buckets).alias("f"))
    rows = rows.withColumn("x", 1 / F.sqrt(F.size("f").cast("double")))
    examples = rows.agg(F.array_sort(F.collect_list(F.struct("i", "label", "x", "f"))).alias("e"))
    held = rows.select(F.explode("f").alias("b"), "i", "x").groupBy("b").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("q"))
    empty = F.array().cast("array<struct<i:int,x:double>>")
    postings = rows.sparkSession.range(buckets).join(held, F.col("id") == F.col("b"), "left")
    postings = postings.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("q", empty).alias("q")))), lambda s: s["q"]).alias("p"))
    one = rows.sparkSession.range(1).select(examples.scalar().alias("e"), postings.scalar().alias("p"))
    n = F.greatest(F.size("e"), F.lit(1)).cast("double")

    def step(w, _):
        def error(x):
            margin = F.get(w, F.lit(buckets)) + x["x"] * F.aggregate(x["f"], F.lit(0.0), lambda a, b: a + F.get(w, b))
            return x["label"] - 1 / (1 + F.exp(-margin))

        def moved(err):
            new = F.transform("p", lambda q, b: F.get(w, b) * (1 - decay) + rate * F.aggregate(q, F.lit(0.0), lambda a, s: a + F.get(err, s["i"]) * s["x"]))
            bias = F.get(w, F.lit(buckets)) + rate * F.aggregate(err, F.lit(0.0), lambda a, s: a + s) / n
            return F.concat(new, F.array(bias))

        return F.get(F.transform(F.array(F.transform("e", error)), moved), F.lit(0))

    start = F.array_repeat(F.lit(0.0), buckets + 1)
    trained = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("w"))
    return trained.first()["w"]


def probability(host, path, weights: list[float]):
    """The model's probability that a URL is to be blocked."""
    w, f = F.lit(weights), features(host, path, len(weights) - 1)
    margin = F.transform(F.array(f), lambda f: weights[-1] + F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(w, b)) / F.sqrt(F.size(f).cast("double")))
    return 1 / (1 + F.exp(-F.get(margin, F.lit(0))))


def rule_for(host, path, rules=RULES):
    """The longest rule that fits, as struct(rule, verdict), or null. ``rules``: a few (verdict, rule)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for every row of (page_id, url)."""
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    df = df.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("block_probability", probability(F.col("host"), F.col("path"), weights))
    model = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return df.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", model).alias("verdict"), F.round("block_probability", 9).alias("block_probability"))


def query(spark, sf_dir: str) -> DataFrame:
    weights = fit(labelled_urls(spark))
    return judge(table(spark, sf_dir, "pages"), weights)


def _sql_parts(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '(?s)^(.*?)://([^/?#]*)', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"


def _sql_features() -> str:
    def hashed(tag, column, n):
        t = f"regexp_replace('^' || {column} || '$', '[0-9]', '0', 'g')"
        return f"list_transform(range(1, greatest(length({t}) - {n - 1}, 1) + 1), lambda i: ('0x' || substr(md5('{tag}{n}' || substr({t}, i, {n})), 1, 8))::BIGINT % {BUCKETS})"

    every = [hashed(tag, c, n) for tag, c in (("h", "host"), ("p", "path")) for n in GRAMS]
    return "list_distinct(" + " || ".join(every) + ")"


def _sql_rules(i: int) -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: len(r[1])):
        host, slash, path = rule[1].partition("/")
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{rule[i]}' ELSE {out} END"
    return out


_VALUES = ", ".join(f"('{u}', {y}.0::DOUBLE)" for y, urls in ((0, ALLOWED), (1, BLOCKED)) for u in urls)
_MARGIN = f"w[{BUCKETS + 1}] + list_sum(list_transform(f, lambda b: w[b + 1])) / sqrt(len(f)::DOUBLE)"
ORACLE = f"""
WITH RECURSIVE labelled(url, label) AS (VALUES {_VALUES}),
rows AS (SELECT row_number() OVER (ORDER BY url) - 1 AS i, label, f, 1 / sqrt(len(f)::DOUBLE) AS x FROM (SELECT url, label, {_sql_features()} AS f FROM (SELECT url, label, {_sql_parts("url")} FROM labelled))),
held AS (SELECT b, list({{'i': i, 'x': x}} ORDER BY i) AS q FROM (SELECT unnest(f) AS b, i, x FROM rows) GROUP BY b),
one AS (SELECT (SELECT list({{'label': label, 'x': x, 'f': f}} ORDER BY i) FROM rows) AS e, (SELECT list(coalesce(q, []) ORDER BY r.range) FROM range({BUCKETS}) r LEFT JOIN held ON held.b = r.range) AS p),
steps(t, w) AS (
  SELECT 0, list_transform(range({BUCKETS + 1}), lambda i: 0.0::DOUBLE)
  UNION ALL
  SELECT t + 1, list_transform(range({BUCKETS}), lambda b: w[b + 1] * (1 - {DECAY}::DOUBLE) + {RATE}::DOUBLE * coalesce(list_sum(list_transform(p[b + 1], lambda s: err[s.i + 1] * s.x)), 0.0))
         || [w[{BUCKETS + 1}] + {RATE}::DOUBLE * list_sum(err) / len(err)]
  FROM (SELECT t, w, p, list_transform(e, lambda r: r.label - 1 / (1 + exp(-(w[{BUCKETS + 1}] + r.x * list_sum(list_transform(r.f, lambda b: w[b + 1])))))) AS err FROM steps, one WHERE t < {STEPS})),
trained AS (SELECT w FROM steps WHERE t = {STEPS}),
parts AS (SELECT page_id, {_sql_parts("url")} FROM pages),
scored AS (SELECT page_id, host, path, 1 / (1 + exp(-({_MARGIN}))) AS p FROM (SELECT *, {_sql_features()} AS f FROM parts), trained)
SELECT page_id, host, path, {_sql_rules(1)} AS rule, coalesce({_sql_rules(0)}, CASE WHEN p >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(p, 9) AS block_probability FROM scored
"""
