"""Operator 3: URL filters.  Rules first; where none fits, logistic regression on hashed character
n-grams of host and path, in native expressions.

The model is trained on the driver from a small table of our own (160 urls of whole hosts and paths, whatever
the corpus; none is taken from a table that is judged): full-batch gradient descent in plain Python.  Weights are rounded to millionths, so scores are
exact integer sums and do not depend on the order of addition.  The weights travel as one literal array
of BUCKETS numbers.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule, and the model
judges it by its bias alone; letters outside A-Z keep their case; empty and very long urls are scored
over all their n-grams; repeated rows are judged alike; an empty table gives an empty table; other columns
pass, and one named host, path, rule, verdict or score is an error.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm.common import refuse_clash, table

BUCKETS = 8191
SIZES = (3, 4)
#: Multipliers of the n-gram hash, one for each place in the n-gram and one for host or path.
PLACES = (7919, 104729, 1299709, 15485863)
HOST_SALT, PATH_SALT = 12289, 40961
SCALE = 1_000_000
#: Folds of the labelled table, for the held-out accuracy.
FOLDS = 5

#: (verdict, host, path): the longest fitting rule decides.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: Our own labelled table: hosts and paths as they occur on the web, one for each line.
_BLOCK = """
luckyspin-roulette.net/bonus/no-deposit
www.pokerroom-online.com/register?aff=2281
megaslots777.com/jackpot/play-now
sportsbetting-tips.info/odds/today
royal-jackpot-slots.com/en/welcome-bonus
bestbookmaker24.com/betting/live
onlineroulette-bonus.org/claim
blackjack-vip.com/signup/deposit
stakes-poker.biz/tournament/bonus
lottery-results-claim.com/prize/collect
bitcoin-doubler.biz/invest/now
crypto-profit-bot.com/signup/guaranteed
forex-signals-millionaire.com/join
earn-cash-daily.com/work-from-home
quickpayday-loan.com/apply/no-credit-check
instant-loans-approved.net/apply
make-money-fast.biz/secret-method
passive-income-secrets.com/order
binary-options-profit.com/demo
loan-no-credit-check.org/apply-now
buy-viagra-online.net/order/no-prescription
canadian-pharmacy-meds.com/cialis/discount
discount-pharmacy-rx.biz/products/viagra
weightloss-miracle.com/keto-gummies
keto-slim-offer.com/order/bottle
hairloss-cure-secret.com/order
meds-no-prescription.com/xanax/buy
steroids-online-shop.biz/order
testosterone-booster-deal.com/offer
cialis-generic-discount.org/buy
hot-webcam-girls.com/live/chat
xxx-tube-videos.net/watch/hd
porn-hd-stream.com/videos/milf
sexy-singles-dating.com/hookup/tonight
escort-service-vip.net/girls
nude-cams-live.com/room/14
hookup-local-singles.biz/join
amateur-porn-clips.org/watch
webcam-sex-chat.net/rooms
milf-dating-tonight.com/signup
adserver-popunder.com/click/redirect
banner-exchange-network.biz/impression
pixel-tracker-stats.net/collect
affiliate-redirect.click/go/offer
popup-push-notify.com/subscribe/allow
clickserve-rtb.net/bid/redirect
counter-beacon.net/pixel.gif
promo-redirect.top/lp/offer
adclick-server.net/delivery/ck.php
pushnotification-allow.top/lp
secure-login-verify-account.com/paypal/update
appleid-verify-support.net/login/confirm
bank-account-verify.top/secure/login
claim-your-iphone.top/claim/prize
update-your-flash-player.net/download/setup.exe
virus-alert-support.top/scan/call-now
account-suspended-verify.com/signin
giftcard-generator.top/survey/human-verification
crackedsoftware-keygen.net/download/serial
torrent-warez-downloads.com/crack/full-version
keygen-activator.biz/windows/crack
movie-stream-hd-nologin.to/watch/full
nulled-scripts.top/download/plugin
hack-instagram-password.com/online/tool
unlimited-gems-hack.top/generator
replica-watches-outlet.com/rolex/sale
designer-handbags-outlet.top/louis/discount
discount-jerseys-outlet.top/nfl/sale
rayban-outlet-sale.top/90-off
essay-writing-service.biz/order/buy-essay
buy-followers-likes.com/instagram/order
backlinks-seo-service.top/buy/10000-links
seo-links-pbn.biz/order/gig
comment-blast-software.biz/xrumer/download
article-spinner.top/auto/rewrite
bulk-email-lists.biz/buy/leads
guest-post-links.top/any-niche-accepted
you-wont-believe-this.top/shocking/celebrity
celebrity-shocking-photos.top/gallery/click
doctors-hate-this-trick.top/belly-fat
"""
_ALLOW = """
en.wikipedia.org/wiki/Photosynthesis
de.wikipedia.org/wiki/Elbe
www.gutenberg.org/files/1342/1342-h/1342-h.htm
archive.org/details/historyofrome
www.nature.com/articles/s41586-020-2649-2
arxiv.org/abs/1706.03762
www.jstor.org/stable/2118477
pubmed.ncbi.nlm.nih.gov/31978945
plato.stanford.edu/entries/kant-moral
ocw.mit.edu/courses/mathematics/18-06-linear-algebra
www.bbc.co.uk/news/science-environment-56837908
www.theguardian.com/books/2019/nov/14/review
www.nytimes.com/2018/05/12/travel/lisbon.html
www.lemonde.fr/planete/article/2020/06/01/climat.html
www.spiegel.de/wissenschaft/natur/wald.html
elpais.com/cultura/2021/03/04/libros.html
www.reuters.com/world/europe
apnews.com/article/weather-storms
www.npr.org/sections/health-shots/2017/11/02
www.economist.com/finance/2016/09/17
docs.python.org/3/library/itertools.html
spark.apache.org/docs/latest/sql-programming-guide.html
developer.mozilla.org/en-US/docs/Web/HTTP
www.postgresql.org/docs/current/indexes.html
doc.rust-lang.org/book/ch04-01-what-is-ownership.html
kubernetes.io/docs/concepts/overview
stackoverflow.com/questions/11227809
github.com/numpy/numpy/issues/1204
www.kernel.org/doc/html/latest/process
numpy.org/doc/stable/reference/arrays.html
unix.stackexchange.com/questions/24630
lists.debian.org/debian-devel/2015/03
www.gov.uk/guidance/register-a-birth
www.europarl.europa.eu/about-parliament/en
www.nasa.gov/missions/voyager
www.loc.gov/collections/maps
www.weather.gov/forecast/boston
www.who.int/health-topics/malaria
www.census.gov/data/tables/2020
www.parliament.uk/business/committees
www.cityofdublin.ie/council/minutes
www.bundestag.de/dokumente/protokolle
library.harvard.edu/services/borrow
www.ox.ac.uk/research/history
www.ethz.ch/en/studies/physics.html
biology.university.edu/faculty/research
math.berkeley.edu/people/lecture-notes
museum.gallery.org/exhibitions/ceramics
www.rijksmuseum.nl/en/collection
www.britishmuseum.org/collection/egypt
www.seriouseats.com/sourdough-bread-recipe
www.kingarthurbaking.com/recipes/rye
kitchen-garden-notes.org/tomatoes/pruning
gardening.stackexchange.com/questions/812
www.hikingalps.ch/routes/day-three
birdwatching-journal.org/spring/warblers
www.chess-club.org/games/endgame-studies
orchestra-society.org/concerts/brahms
knitting-patterns-blog.org/socks/heel
www.woodworkers-guild.org/projects/bench
railway-history.org/stations/harbour
astronomy-club.org/observing/jupiter
www.lighthouse-cottage.co.uk/rooms
coffee-roasters-review.org/brewing
family-history-society.org/records/parish
teachers-network.org/lessons/fractions
community-theatre.org/season/tickets
village-school.sch.uk/term-dates
animal-shelter.org/dogs/adoption
volunteer-firefighters.org/training
www.bookshop.org/history/medieval
poetryfoundation.org/poems/ode
linguistics-blog.org/2014/grammar/verbs
old-maps-online.org/europe/1850
chemistry-tutor.org/acids/titration
climate-data.org/stations/snowfall
ecology-letters.org/volume/12/forest
philosophy-talks.org/episodes/ethics
www.farmers-weekly.co.uk/wheat/harvest
local-newspaper.com/sports/football/results
"""


_FRONTS, _ENDS = ("", "www.", "m.", "blog.", "shop."), ("com", "net", "org", "example.com", "example.net", "example.org", "co.uk")
_PATHS = ("/", "/en/12", "/index.html", "/fr/3041/", "/2024/05/", "/de/77.html", "/es/509", "/a/b/c")


@functools.lru_cache(maxsize=1)
def labelled() -> tuple[tuple[str, str, int], ...]:
    """The labelled table: (host, path, 1 for block)."""
    rows = []
    for label, lines in ((1, _BLOCK), (0, _ALLOW)):
        for line in lines.split():
            host, _, path = line.partition("/")
            rows.append((host, "/" + path.partition("?")[0], label))
    return tuple(rows)


def _variants(i: int, row: tuple[str, str, int]) -> list[tuple[str, str, int]]:
    """A labelled url, and its host under other fronts, ends and paths that both labels get alike, so that
    these say nothing."""
    host, path, label = row
    stem = host.removeprefix("www.").rpartition(".")[0]
    made = [(f"{_FRONTS[(i + k) % len(_FRONTS)]}{stem}.{_ENDS[(i + k) % len(_ENDS)]}", _PATHS[(i + k) % len(_PATHS)], label) for k in range(4)]
    return [row, *made]


def _buckets(text: str, salt: int) -> list[int]:
    codes = [ord(c) for c in f"^{text}$"]
    return [(sum(codes[i + j] * PLACES[j] for j in range(n)) + salt * n) % BUCKETS for n in SIZES for i in range(len(codes) - n + 1)]


@functools.lru_cache(maxsize=8)
def trained(left_out: int | None = None, epochs: int = 60, rate: float = 30.0, decay: float = 1e-4) -> tuple[tuple[int, ...], int]:
    """(weights, bias) in millionths.  A url's score is the sum of its n-grams' weights plus, for each
    n-gram, the bias: block if it is above 0.  ``left_out``: the fold (of FOLDS) that isn't trained on."""
    rows = []
    for host, path, label in (v for i, r in enumerate(labelled()) if i % FOLDS != left_out for v in _variants(i, r)):
        grams = _buckets(host, HOST_SALT) + _buckets(path, PATH_SALT)
        counts: dict[int, float] = {}
        for g in grams:
            counts[g] = counts.get(g, 0.0) + 1.0 / len(grams)
        rows.append((counts, label))
    share = sum(label for _, label in rows) / len(rows)
    weights, bias = [0.0] * BUCKETS, math.log(share / (1 - share))
    for _ in range(epochs):
        step: dict[int, float] = {}
        total = 0.0
        for counts, label in rows:
            z = bias + sum(weights[g] * x for g, x in counts.items())
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            total += error
            for g, x in counts.items():
                step[g] = step.get(g, 0.0) + error * x
        for g, s in step.items():
            weights[g] -= rate * (s + decay * weights[g])
        bias -= 0.3 * total / len(rows)
    return tuple(round(w * SCALE) for w in weights), round(bias * SCALE)


def held_out_accuracy() -> float:
    """The share of labelled urls that a model judges right which was trained without their fold."""
    right = 0
    for i, (host, path, label) in enumerate(labelled()):
        weights, bias = trained(i % FOLDS)
        right += (sum(weights[g] + bias for g in _buckets(host, HOST_SALT) + _buckets(path, PATH_SALT)) > 0) == bool(label)
    return right / len(labelled())


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    after = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = after.substr(F.length(host) + 1, F.length(after))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; rules are few, so they are a CASE.  Long lists
    belong in a table joined on (host suffix, path prefix)."""
    if len(rules) > 256:
        raise ValueError("join a table of rules instead of a CASE")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(of_path)
        rule, verdict = F.when(fits, F.lit(of_host + of_path)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _gram_sum(text: str, salt: int, weights: str) -> str:
    """SQL for struct(sum of weights, number of n-grams) over the characters of ``text``."""
    codes = f"transform(regexp_extract_all(concat('^', {text}, '$'), '(?s).', 0), c -> cast(ascii(c) as long))"
    sums = []
    for n in SIZES:
        hashed = " + ".join(f"element_at(k, i + {j}) * {PLACES[j]}L" for j in range(n))
        sums.append(f"aggregate(if(size(k) >= {n}, sequence(1, size(k) - {n - 1}), array()), 0L, (a, i) -> a + element_at({weights}, cast(({hashed} + {salt * n}L) % {BUCKETS} as int) + 1))")
    return f"element_at(transform(array({codes}), k -> {' + '.join(sums)}), 1)"


def judge(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and score (the model's probability of block)."""
    refuse_clash(pages, {"host", "path", "rule", "verdict", "score"})
    weights, bias = trained()
    host, path = host_and_path(F.col(url))
    grams = lambda c: " + ".join(f"greatest(length({c}) + 2 - {n - 1}, 0)" for n in SIZES)
    own = "_"
    while any(c.lower().startswith(own) for c in pages.columns):
        own += "_"
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    out = out.withColumn("rule", rule).withColumn(f"{own}__rule_says", verdict)
    out = out.withColumn(f"{own}__w", F.expr(f"array({','.join(f'{w}L' for w in weights)})"))
    out = out.withColumn(f"{own}__sum", F.expr(f"{_gram_sum('host', HOST_SALT, f'{own}__w')} + {_gram_sum('path', PATH_SALT, f'{own}__w')}")).drop(f"{own}__w")
    out = out.withColumn(f"{own}__grams", F.expr(f"cast({grams('host')} + {grams('path')} as long)"))
    out = out.withColumn(f"{own}__points", F.expr(f"{own}__sum + {own}__grams * {bias}L"))
    out = out.withColumn("verdict", F.coalesce(f"{own}__rule_says", F.when(F.col(f"{own}__points") > 0, "block").otherwise("allow")))
    out = out.withColumn("score", F.expr(f"1 / (1 + exp(-cast({own}__points as double) / (greatest({own}__grams, 1) * {float(SCALE)!r}D)))"))
    return out.drop(f"{own}__rule_says", f"{own}__sum", f"{own}__grams", f"{own}__points")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    weights, bias = trained()
    rules = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'says': '{v}'}}" for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    )
    parts = []
    for column, salt in (("host", HOST_SALT), ("path", PATH_SALT)):
        for n in SIZES:
            hashed = " + ".join(f"unicode(q.{column}[i + {j}:i + {j}])::BIGINT * {PLACES[j]}" for j in range(n))
            parts.append(f"coalesce(list_sum(list_transform(range(1, length(q.{column}) - {n - 2}), lambda i: w[(({hashed} + {salt * n}) % {BUCKETS})::INT + 1] + {bias})), 0)")
    return f"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
c AS (SELECT page_id, translate(h, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT {list(weights)}::BIGINT[] AS w),
e AS (SELECT *, CASE {rules} END AS r FROM c),
q AS (SELECT page_id, '^' || host || '$' AS host, '^' || path || '$' AS path FROM c),
s AS (SELECT page_id, {' + '.join(parts)} AS points FROM q, m)
SELECT e.page_id, e.host, e.path, r.rule AS rule, coalesce(r.says, CASE WHEN points > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM e JOIN s ON e.page_id = s.page_id
"""
