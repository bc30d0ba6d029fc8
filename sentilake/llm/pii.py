"""Personal data by weak supervision, in DataFrame functions.

Base spans are matches of four fixed patterns. For further kinds candidates are matched loosely and three labelers vote on
each, yes, no or not at all: one by the exact form (regex), one by word lists (gazetteer), one by what stands before it
(context). Counts of vote patterns over the corpus, a few dozen rows, go to the driver; expectation-maximisation estimates
each labeler's reliability and the probability behind each pattern; on these soft labels a logistic span classifier over
votes, length and digit share is trained. It decides which candidates become spans; base spans always stay.
"""

import math
from collections import defaultdict

from pyspark.sql import functions as F

# The base patterns, from their first character on; \G or no fitting character before them keeps a search
# that starts inside a run from trying each of its places, with the same matches.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "secret": r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{20,}+",
    "local_phone": r"(?<![0-9+.)-])(?<![0-9] )\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
FORM = {
    "secret": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_]{24,})$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}$",
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "iban": r"^(?:[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))$",
}
WORDS = {
    "secret": "token secret key password passwd apikey api_key access_key bearer auth credential",
    "local_phone": "tel telephone phone call mobile cell fax telefon téléphone teléfono",
    "national_id": "ssn social security national identity id",
    "iban": "iban account konto compte cuenta bank",
}
BEFORE = {"secret": r"[=:]\x20?[\"']?$", "local_phone": r"[:.]\x20?$", "national_id": r"[:#]\x20?$", "iban": r":\x20?$"}
LABELERS = ("form", "words", "before")
CONTEXT = 24
BLOCK = 64
LEAST = 0.5


def _places(values, gaps):
    """Start and end of each match, in code points, from the matches and the texts between them; two levels of sums."""
    step = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.length(g) + F.length(v))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    count = F.size(values)
    blocks = lambda steps: F.transform(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK)))
    with_blocks = F.transform(F.array(step), lambda steps: F.struct(steps.alias("steps"), blocks(steps).alias("blocks")))
    with_before = F.transform(
        with_blocks,
        lambda x: F.struct(
            x["steps"].alias("steps"), F.transform(x["blocks"], lambda _, b: total(F.slice(x["blocks"], F.lit(1), b))).alias("before")
        ),
    )
    return F.flatten(
        F.transform(
            with_before,
            lambda x: F.transform(
                values,
                lambda v, i: F.struct(
                    (F.get(x["before"], F.floor(i / BLOCK).cast("int")) + total(F.slice(x["steps"], F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK + 1)) - F.length(v)).alias("s"),
                    v.alias("v"),
                ),
            ),
        )
    )


def matches(text, pattern, possible):
    """[(s, v)] of the leftmost matches, not overlapping; possible: whether the text can hold any."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, _places(v, F.split(text, pattern, -1))))
    return F.coalesce(F.when(possible, F.get(found, 0)), F.array().cast("array<struct<s:int,v:string>>"))


def digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value):
    """Whether the digits pass: from the right, every second one doubled, the sum a multiple of ten."""
    d = F.transform(F.split(F.reverse(digits(value)), ""), lambda x: x.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(doubled, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind, value):
    n = F.length(digits(value))
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return (n >= 14) & (n <= 19) & luhn(value)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _span_rows(kind, rank, found):
    valid = F.filter(found, lambda m: holds(kind, m["v"]))
    return F.transform(
        valid, lambda m: F.struct(m["s"].alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("kind"), (m["s"] + F.length(m["v"])).alias("e"))
    )


def _base_spans(text, has_digit):
    spans = []
    for rank, kind in enumerate(BASE):
        possible = {"email": text.contains("@"), "phone": has_digit & text.contains("+")}.get(kind, has_digit)
        spans.append(_span_rows(kind, rank, matches(text, BASE[kind], possible)))
    return F.array_sort(F.concat(*spans))


def _votes(kind, value, before):
    """Each labeler's vote: y, n or - for none."""
    word = "(?:^|[^a-z])(?:" + "|".join(WORDS[kind].split()) + ")[^a-z]*$"
    return {
        "form": F.when(value.rlike(FORM[kind]), "y").otherwise("n"),
        "words": F.when(F.lower(before).rlike(word), "y").otherwise("-"),
        "before": F.when(before.rlike(BEFORE[kind]), "y").when(before.rlike(r"[A-Za-z0-9]$"), "n").otherwise("-"),
    }


def _features(value):
    share = F.round(5 * F.length(digits(value)) / F.length(value)).cast("int")
    return {"size": F.least(F.floor(F.length(value) / 8), F.lit(8)).cast("string"), "digits": share.cast("string")}


def _candidate_rows(text, kind, rank, found):
    def one(m):
        before = F.substring(text, F.greatest(m["s"] - CONTEXT + 1, F.lit(1)), F.least(m["s"], F.lit(CONTEXT)))
        parts = [F.lit(kind), *_votes(kind, m["v"], before).values(), *_features(m["v"]).values()]
        return F.struct(
            m["s"].alias("s"), F.lit(rank).alias("r"), F.lit(kind).alias("kind"), (m["s"] + F.length(m["v"])).alias("e"), F.concat_ws("|", *parts).alias("key")
        )

    return F.transform(found, one)


def _candidates(text, has_digit, base):
    """[(s, r, kind, e, key)] of the loose matches that overlap no base span; key: kind, votes and features."""
    found = [_candidate_rows(text, kind, rank, matches(text, LOOSE[kind], has_digit)) for rank, kind in enumerate(LOOSE, len(BASE))]
    free = lambda c: ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
    return F.filter(F.concat(*found), free)


def reliabilities(patterns, rounds=50):
    """{kind: (prior, {labeler: {vote: (if a span, if not)}})} and the posterior of each pattern, from {(kind, votes): count}.

    Votes count as independent given the truth. Pseudo-counts hold the estimate where a kind has few candidates.
    """
    out, posterior = {}, {}
    for kind in LOOSE:
        own = {v: n for (k, v), n in patterns.items() if k == kind}
        if not own:
            continue
        prior = 0.5
        rate = {x: {"y": (0.6, 0.1), "n": (0.1, 0.5), "-": (0.3, 0.4)} for x in LABELERS}
        start = {x: dict(r) for x, r in rate.items()}
        for _ in range(rounds):
            for votes in own:
                yes, no = math.log(prior), math.log(1 - prior)
                for x, v in zip(LABELERS, votes, strict=True):
                    yes, no = yes + math.log(rate[x][v][0]), no + math.log(rate[x][v][1])
                posterior[kind, votes] = 1 / (1 + math.exp(max(-700, min(700, no - yes))))
            total = sum(own.values())
            mass = sum(n * posterior[kind, v] for v, n in own.items())
            prior = (mass + 2) / (total + 4)
            for i, x in enumerate(LABELERS):
                for v in "yn-":
                    hit = [(n, posterior[kind, votes]) for votes, n in own.items() if votes[i] == v]
                    # The start counts for ten candidates, so a labeler keeps its meaning on few.
                    rate[x][v] = (
                        (sum(n * p for n, p in hit) + 10 * start[x][v][0]) / (mass + 10),
                        (sum(n * (1 - p) for n, p in hit) + 10 * start[x][v][1]) / (total - mass + 10),
                    )
        out[kind] = (prior, rate)
    return out, posterior


def train(keys, rounds=400, step=0.5):
    """Weights of a logistic classifier over a key's parts, from {key: count}, on the labels that the votes give."""
    split = {k: k.split("|") for k in keys}
    patterns = defaultdict(int)
    for k, n in keys.items():
        patterns[split[k][0], tuple(split[k][1:4])] += n
    _, posterior = reliabilities(patterns)
    names = {k: [f"{p[0]}:{i}:{x}" for i, x in enumerate(p)] for k, p in split.items()}
    weights = dict.fromkeys((x for parts in names.values() for x in parts), 0.0)
    totals = defaultdict(int)
    for k, n in keys.items():
        totals[split[k][0]] += n
    for _ in range(rounds):
        slope = defaultdict(float)
        for k, n in keys.items():
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights[x] for x in names[k])))))
            for x in names[k]:
                slope[x] += n / totals[split[k][0]] * (posterior[split[k][0], tuple(split[k][1:4])] - p)
        for x, g in slope.items():
            weights[x] += step * (g - 0.001 * weights[x])
    return weights


def _accepted(key, weights):
    """The classifier's verdict on a candidate's key."""
    if not weights:
        return F.lit(False)
    table = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in pair))
    parts = F.split(key, r"\|")
    names = F.transform(parts, lambda x, i: F.concat_ws(":", F.get(parts, 0), i.cast("string"), x))
    score = F.aggregate(names, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(table, x), F.lit(0.0)))
    return score >= math.log(LEAST / (1 - LEAST))


def _prepared(docs, id_col, text_col):
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("has_digit", F.col("t").rlike("[0-9]"))
    d = d.withColumn("base", _base_spans(F.col("t"), F.col("has_digit")))
    return d.withColumn("candidates", _candidates(F.col("t"), F.col("has_digit"), F.col("base")))


def _found(docs, id_col, text_col):
    """id, t, base and all spans of each row."""
    d = _prepared(docs, id_col, text_col)
    keys = {r["key"]: r["n"] for r in d.select(F.explode("candidates.key").alias("key")).groupBy("key").agg(F.count("*").alias("n")).collect()}
    weights = train(keys)
    more = F.filter("candidates", lambda c: _accepted(c["key"], weights))
    plain = F.transform(more, lambda c: F.struct(c["s"].alias("s"), c["r"].alias("r"), c["kind"].alias("kind"), c["e"].alias("e")))
    return d.select("id", "t", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs, id_col="doc_id", text_col="text"):
    """One row for each row of docs: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Places are code points, ends exclusive. Null text counts as empty; ids, null or repeated, are carried as they are.
    Other columns of docs are not read. An empty table gives none.
    """
    d = _found(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select(F.col("id").alias(id_col), *(count(k) for k in BASE), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def mask(docs, text_col="text"):
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans become the first one's kind, up to the last end. Null stays null."""
    d = _found(docs.withColumn("__row", F.struct(*docs.columns)), "__row", text_col)
    done = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, x: F.when(
            x["s"] >= s["at"],
            F.struct(
                F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, x["s"] - s["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")).alias("out"),
                x["e"].alias("at"),
            ),
        ).otherwise(F.struct(s["out"].alias("out"), F.greatest(s["at"], x["e"]).alias("at"))),
        lambda s: F.concat(s["out"], F.substring(F.col("t"), s["at"] + 1, F.length("t") - s["at"])),
    )
    masked = F.when(F.size("spans") > 0, done).otherwise(F.col(f"id.{text_col}"))
    return d.select("id", masked.alias("masked")).select(*(F.col("masked").alias(c) if c == text_col else F.col(f"id.{c}").alias(c) for c in docs.columns))
