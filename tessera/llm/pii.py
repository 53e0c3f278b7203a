"""Personal data by weak supervision: patterns, gazetteers and contexts vote, expectation-maximisation estimates how reliable
each is, and the votes' posteriors train a span classifier [DataFrame functions only]."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# The base kinds in their order. A match can only start where a run starts or the match before ended; with
# that and possessive repeats each pattern reads a text once, and matches what the plain form matches.
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Kinds that the method proposes on top.
MORE = {
    "secret": r"(?i)(?<=(?:token|secret|passwd|password|apikey|api_key|api-key)[\x22']{0,1}\x20{0,2}[=:]\x20{0,2}[\x22']{0,1})[A-Za-z0-9+/_-]{16,}+",
    "local_phone": r"(?<![0-9+.()-])\(?[0-9]{3}\)?[-.\x20][0-9]{3}[-.][0-9]{4}(?![0-9.-]*[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]*[0-9])",
}
KINDS = [*BASE, *MORE]
#: What a text must hold for a kind to be looked for: a plain scan spares most texts the pattern.
HOLDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "secret": r"(?i)token|secret|passw|api.?key", "local_phone": r"[0-9]{3}[-.][0-9]{4}", "ssn": r"[0-9]{3}-[0-9]{2}-"}
# Words near a span that speak for or against its kind.
CUES = {
    "email": "mail|contact|write|escrib|courriel|kontakt|schreib", "ip": "\\bip\\b|host|server|address|login|client",
    "card": "card|visa|pay|carte|karte|tarjeta", "phone": "phone|call|\\btel|fax|mobil|tél|anruf", "secret": "token|secret|passw|key",
    "local_phone": "phone|call|\\btel|fax|mobil|tél|anruf", "ssn": "ssn|social|security",
}
AGAINST = "version|isbn|issn|doi|figure|chapter|section|page"
LEFT, RIGHT = 24, 8
N_VOTES = 6
# The gazetteer by kind, entries that speak for a span and entries that speak against it. An email is looked up by its
# domain and the domain's last part, an address by its leading numbers, cards, phones and numbers by their leading digits and all of
# them, a secret by its first characters and all of them.
KNOWN = {
    "email": "gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com icloud.com aol.com mail.com gmx.de gmx.net web.de t-online.de orange.fr free.fr laposte.net yahoo.fr yahoo.es com org net edu gov de fr es eu io info it nl uk ch at be pt",
    "card": "4 34 35 36 37 38 51 52 53 54 55 62 65 6011",
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 961 962 966 971 972",
    "local_phone": "2 3 4 5 6 7 8 9",
    "secret": "ghp_ gho_ akia xoxb xoxp eyj sk- sk_l pk_l rk_l",
}
NOT_PERSONAL = {
    "email": "example.com example.org example.net example invalid localhost local test",
    "ip": "0 10 127 169.254 192.168 192.0.2 198.18 198.51.100 203.0.113 " + " ".join([*(f"172.{k}" for k in range(16, 32)), *map(str, range(224, 256))]),
    "card": "4111111111111111 4242424242424242 4012888888881881 5555555555554444 5105105105105100 378282246310005 371449635398431 6011111111111117 30569309025904 3530111333300000",
    "local_phone": "0 1",
    "ssn": "000 666 9",
    "secret": "changemechangeme passwordpassword your_api_key_here your-api-key-here insert_token_here 0123456789abcdef deadbeefdeadbeef xxxxxxxxxxxxxxxx abcdefghijklmnop",
}
#: Entries of a gazetteer; it becomes part of the plan.
MAX_GAZETTEER = 10_000


def found(text: Column, kind: str) -> Column:
    """Array of (start, end, found, before, after): leftmost matches, in code points, with a little of the text on both sides."""
    pattern = F.lit({**BASE, **MORE}[kind])
    place = "array<struct<start:bigint,end:bigint,found:string,before:string,after:string>>"
    pieces = F.split(text, {**BASE, **MORE}[kind], -1)
    around = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m, i: F.struct(m.alias("m"), F.get(pieces, i).alias("g"), F.get(pieces, i + 1).alias("next")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(place).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("found"), F.right(x["g"], F.lit(LEFT)).alias("before"), F.left(x["next"], F.lit(RIGHT)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.when(text.rlike(HOLDS[kind]), F.aggregate(around, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(place))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""

    def value(i: Column) -> Column:
        v = F.substring(d, -i, F.lit(1)).cast("int")
        twice = v * 2
        return F.when(i % 2 == 1, v).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def passes(kind: str, x: Column) -> Column:
    """The checks that a match of a base kind must pass."""
    d = digits(x)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def default_gazetteer(spark: SparkSession) -> DataFrame:
    """(kind, entry, vote) of the values known here; a table of one's own may take its place."""
    rows = [(kind, entry, vote) for vote, table in ((1, KNOWN), (-1, NOT_PERSONAL)) for kind, entries in table.items() for entry in entries.split()]
    return spark.createDataFrame(rows, "kind string, entry string, vote int")


def entries(kind: Column, found_: Column) -> Column:
    """What a span is looked up by in the gazetteer, kind in front."""
    low, d = F.lower(found_), digits(found_)
    domain, numbers = F.substring_index(low, "@", -1), F.split(found_, r"\.")
    head = lambda of, *sizes: [*(F.left(of, F.lit(n)) for n in sizes), of]
    keys = F.when(kind == "email", F.array(domain, F.substring_index(domain, ".", -1)))
    keys = keys.when(kind == "ip", F.array(*(F.array_join(F.slice(numbers, 1, n), ".") for n in (1, 2, 3))))
    keys = keys.when(kind == "secret", F.array(*head(low, 3, 4))).otherwise(F.array(*head(d, 1, 2, 3, 4)))
    return F.transform(keys, lambda k: F.concat(kind, F.lit(":"), k))


def looked_up(known: dict[int, list[str]], kind: Column, found_: Column) -> Column:
    """The gazetteer's vote: against where an entry speaks against the span, for where one speaks for it."""
    hit = lambda vote: F.exists(entries(kind, found_), lambda k: k.isin(known.get(vote, [])))
    return F.when(hit(-1), -1).when(hit(1), 1).otherwise(0)


def votes(kind: Column, x: Column, known: dict[int, list[str]]) -> list[Column]:
    """Six labelers, each 1 (personal data), -1 (not) or 0 (no opinion): the span's shape, the words before it, the characters before and
    after it, how many different characters it has, and the gazetteer."""
    text, before, after = x["found"], F.lower(x["before"]), x["after"]
    variety = F.size(F.array_distinct(F.split(F.lower(text), "")))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, before.rlike(words)).otherwise(cue)
    odd = text.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1)+[^0-9]*$")
    proper = text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\+?[0-9]?[\x20]?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}$|^[3-6][0-9]{12,18}$|^[0-9a-f]{32,}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    return [
        F.when(odd, -1).when(proper, 1).otherwise(0),
        F.when(before.rlike(AGAINST), -1).when(cue, 1).otherwise(0),
        F.when(before.rlike(r"[\w]$"), -1).when(before.rlike(r"[:=(<\x22']\x20?$"), 1).otherwise(0),
        F.when(variety <= 2, -1).when(variety >= 5, 1).otherwise(0),
        F.when(after.rlike(r"^[\w]"), -1).when(after.rlike(r"^(?:$|[\s.,;:)>\x22'!?])"), 1).otherwise(0),
        looked_up(known, kind, text),
    ]


def features(kind: Column, x: Column) -> list[Column]:
    """What the classifier looks at besides the votes' cues: kind with length, variety and the characters on both sides."""
    n = F.length(x["found"])
    side = lambda c: F.when(c.rlike(r"^$"), "edge").when(c.rlike(r"^\s$"), "space").when(c.rlike(r"^\w$"), "word").otherwise("mark")
    variety = F.least(F.size(F.array_distinct(F.split(x["found"], ""))), F.lit(12))
    return [
        F.concat_ws("=", kind, F.floor(F.log2(n)).cast("string")),
        F.concat_ws("=", F.lit("variety"), variety.cast("string")),
        F.concat_ws("=", F.lit("before"), kind, side(F.right(x["before"], F.lit(1)))),
        F.concat_ws("=", F.lit("after"), kind, side(F.left(x["after"], F.lit(1)))),
    ]


def candidates(docs: DataFrame, known: dict[int, list[str]]) -> DataFrame:
    """Staged: doc_id and all candidate spans of each row's whole text, base ones that pass and proposals that overlap none of them."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    raw = text.select("doc_id", *(found(F.col("text"), k).alias(k) for k in KINDS))

    def tagged(kind: str, keep: Column) -> Column:
        return F.transform(keep, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found"), x["before"].alias("before"), x["after"].alias("after")))

    def passing(kind: str) -> Column:
        return F.filter(F.col(kind), lambda x: passes(kind, x["found"]))

    base = F.concat(*(tagged(k, passing(k)) for k in BASE))
    more = F.concat(*(tagged(k, F.col(k)) for k in MORE))
    spans = raw.select("doc_id", base.alias("base"), more.alias("more"))
    free = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    voted = F.transform(F.concat("base", free), lambda x: F.struct(*(x[c].alias(c) for c in ("start", "rank", "end", "kind")), F.array(*votes(x["kind"], x, known)).alias("votes"), F.array(*features(x["kind"], x)).alias("features")))
    return stage(spans.select("doc_id", voted.alias("spans")), "candidates")


def reliabilities(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Expectation-maximisation over counted vote patterns (kind, votes): each labeler's rates of votes on true and false
    spans, and each kind's share of true ones. Returns every pattern's posterior. 7 * 3**6 patterns at most."""
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p[1]) - 0.5)) for p in counts}
    for _ in range(rounds):
        prior, rate = {}, {}
        for kind in KINDS:
            mine = [(post[p], n) for p, n in counts.items() if p[0] == kind]
            prior[kind] = (sum(q * n for q, n in mine) + 1) / (sum(n for _, n in mine) + 2)
        for j, v, true in product(range(N_VOTES), (-1, 0, 1), (True, False)):
            hit = sum((q if true else 1 - q) * n for p, n in counts.items() for q in [post[p]] if p[1][j] == v)
            everything = sum((post[p] if true else 1 - post[p]) * n for p, n in counts.items())
            lean = 2.0 if (v == 1) == true and v else 1.0  # a labeler is better than chance to begin with
            rate[j, v, true] = (hit + lean) / (everything + 4)
        for kind, vs in counts:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(rate[j, v, True] / rate[j, v, False]) for j, v in enumerate(vs))
            post[kind, vs] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post


def train_classifier(spans: DataFrame) -> tuple[float, dict[str, float]]:
    """(bias, weight by feature) of a naive Bayes span classifier trained on posteriors. Counts of vote patterns and sums by
    feature reach the driver: both have fixed numbers of keys."""
    each = spans.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features")
    counts = {(r["kind"], tuple(r["votes"])): r["count"] for r in each.groupBy("kind", "votes").count().collect()}
    if not counts:
        return 0.0, {}
    post = reliabilities(counts)
    known = spans.sparkSession.createDataFrame([(k, list(v), p) for (k, v), p in post.items()], "kind string, votes array<int>, p double")
    sums = each.join(F.broadcast(known), ["kind", "votes"]).select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p"), F.sum(1 - F.col("p"))).collect()
    yes, no = sum(post[p] * n for p, n in counts.items()) + 1, sum((1 - post[p]) * n for p, n in counts.items()) + 1
    return math.log(yes / no), {f: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for f, a, b in sums}


def find_pii(docs: DataFrame, threshold: float = 0.5, gazetteer: DataFrame | None = None) -> DataFrame:
    """doc_id, n_<base kind>, base (array of (start, rank, end, kind)) and spans (base and what the classifier adds), by start then kind.

    Offsets are code points, ends exclusive. Base spans stay whatever the classifier says; added ones reach threshold.
    A null or empty text has no spans. Each row is read by itself, repeated ones too. gazetteer: (kind, entry, vote 1 or -1), at
    most MAX_GAZETTEER rows, in lower case; nulls are left out.
    """
    table = gazetteer if gazetteer is not None else default_gazetteer(docs.sparkSession)
    listed = table.select("kind", "entry", "vote").where("kind is not null and entry is not null and vote in (1, -1)").distinct().limit(MAX_GAZETTEER + 1).collect()
    if len(listed) > MAX_GAZETTEER:
        raise ValueError(f"a gazetteer has at most {MAX_GAZETTEER} entries")
    spans = candidates(docs, {vote: [f"{r['kind']}:{r['entry']}" for r in listed if r["vote"] == vote] for vote in (1, -1)})
    bias, weights = train_classifier(spans)
    weight = F.create_map(*(F.lit(v) for f, w in sorted(weights.items()) for v in (f, w))) if weights else F.create_map(F.lit(""), F.lit(0.0))

    def score(x: Column) -> Column:
        return F.aggregate(x["features"], F.lit(float(bias)), lambda a, f: a + F.coalesce(weight[f], F.lit(0.0)))

    limit = math.log(threshold / (1 - threshold))
    plain = lambda arr: F.array_sort(F.transform(arr, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    base = plain(F.filter("spans", lambda x: x["rank"] < len(BASE)))
    every = plain(F.filter("spans", lambda x: (x["rank"] < len(BASE)) | (score(x) >= limit)))
    out = spans.select("doc_id", base.alias("base"), every.alias("spans"))

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(number(k) for k in BASE), "base", "spans")


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
