"""URL filters: host and path rules, and for the rest a naive Bayes score of segmented names.

Host labels and path parts are segmented into words by a unigram Viterbi; the unigram counts come from
all URLs of the table together with a small fixed list of words. A multinomial naive Bayes model,
fitted on labelled names, scores the words.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

# The labelled sample that the model is fitted on unless the caller has one of their own: names such as
# hosts and paths have, written as words, of general vocabulary. Its words are also the first that segmentation knows.
BLOCKED = """
casino; online casino; casino bonus; free casino slots; casino poker; vegas casino jackpot; mobile casino games; royal casino;
poker; poker bonus; texas poker room; slots; free slots; mega slots jackpot; jackpot winner; lottery; lottery winner; win prize; you win; free spins;
bet; bets; sports bets; betting; betting tips; betting odds; best betting bonus; roulette wheel; bingo bonus; gambling; online gambling; gambling bets; gambling tips; gamble online; blackjack table; baccarat; bookmaker odds; sportsbook bonus; wager bonus; scratch cards win;
pills; diet pills; buy pills online; viagra; cheap viagra; buy viagra; cialis; cialis online; cheap pharma; online pharmacy cheap; meds cheap; steroids online; xanax; tramadol online; pills shop; discount pills; erection pills;
porn; free porn; porn tube; porn videos; sex; sex cams; sex dating; live sex; xxx; xxx videos; xxx tube; adult; adult cams; adult dating; adult videos; adult blog; adult toys; porn blog; casino blog; spam blog; adult chat; erotic massage; sexy singles; fetish tube; webcam girls; nude; nude cams; nude girls; escort; hot escort girls; hookup dating;
payday loan; payday loans; fast cash loans; quick cash; cheap loans; easy money; make money fast; get rich fast; bitcoin doubler; crypto giveaway;
warez; warez crack; crack keygen; serial keygen; torrent crack; malware; spam; click farm; link farm; seo links cheap; spam mail; mass spam; bulk spam sender; email spam tool; content farm; track clicks; tracking ads; banner ads; adserver; ads server; ads click; tracking pixel; track users; replica watch; replica watches; cheap replica; replica bags; miracle diet; weight loss miracle; free iphone giveaway; free gift card; ad tracker; click tracker; ads; ads network; popup ads
"""
ALLOWED = """
news; world news; daily news; local news; news archive; news review; sports news; blog; my blog; travel blog; food blog; tech blog; personal blog;
wiki; docs; help; help center; support; about; contact; forum; community forum; book; books; book review; library; public library; digital library; school; high school; university; college; science; science review; research; research center; open data; open source; open access journal; journal of science;
health; public health; health center; hospital; medical center; pharmacy school; weather; weather maps; travel; travel guide; city guide; city council; maps; music; music school; music review; art; art museum; history museum; museum; history; sport club; football club; garden; home garden; food recipes; recipes; family; family doctor; world health; world history; learn code; code school; open code; learn english; software tools; tools; press; free press; radio; public radio; cheap flights; free software; free books; adult education; sex education; bank; credit union; student loans; home loans; games; board games; chess club; safety first; free trial; win win strategy; track and field; track record; farm; farm shop; organic farm; dairy farm; best of; online; online shop; online course; buy local; cheap eats; tips; tips and tricks; cooking tips; live; live music; live scores; video; videos; photo gallery; fashion; shop; bike shop; market; farmers market; table tennis; wheel; room; girls school; women in science; dating a fossil; cash register; bonus track; email; mail; tool box; content; banner; chat; cards; card games; discount store
"""
LONGEST_WORD = 24
#: What each count of a word in the labelled sample adds to its count in the URLs, and letters that a cut of a name advances.
LISTED, STEP = 20.0, 1000


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?` or `#`."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null.

    A rule ("block", "example.net/de/") fits its host and all subdomains of it where the path starts
    with the rule's. At most 1000 rules: they are written into the plan.
    """
    if len(rules) > 1000:
        raise ValueError("at most 1000 rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(set(rules), key=lambda r: (len(r[1]), r[1], r[0])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def viterbi(name: str, counts: dict[str, float], total: float) -> list[str]:
    """The most probable split of `name`; unknown words cost by length, ties go to fewer, then longer first words."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            word = name[start:end]
            seen = counts.get(word)
            cost = math.log(total / seen) if seen else math.log(total) + 2.5 * len(word)
            options.append((best[start][0] + cost, best[start][1] + 1, start))
        best.append(min(options))
    out, end = [], len(name)
    while end:
        out.append(name[best[end][2] : end])
        end = best[end][2]
    return out[::-1]


def labelled_names(text: str, label: str) -> list[tuple[list[str], str]]:
    """[(words, label)] of names separated by semicolons."""
    return [(name.split(), label) for name in text.split(";") if name.strip()]


DEFAULT_LABELLED = labelled_names(BLOCKED, "block") + labelled_names(ALLOWED, "allow")


def fit_bayes(labelled: list[tuple[list[str], str]], smoothing: float = 1.0, block_share: float = 0.25) -> dict:
    """Multinomial naive Bayes over (words, "block" or "allow"): counts of words by class, smoothed.

    The sample is chosen, not drawn, so its shares say nothing of URLs at large: the prior is `block_share`.
    """
    counts = {"block": Counter(), "allow": Counter()}
    for words, label in labelled:
        counts[label].update(words)
    seen = counts["block"] + counts["allow"]
    chance = {c: {w: math.log((n[w] + smoothing) / (n.total() + smoothing * len(seen))) for w in seen} for c, n in counts.items()}
    ratio = {w: chance["block"][w] - chance["allow"][w] for w in seen}
    return {"ratio": ratio, "prior": math.log(block_share / (1 - block_share)), "counts": dict(seen)}


def log_odds(words: list[str], model: dict) -> float:
    """Log odds of block against allow; words that the model never saw count for neither side."""
    return model["prior"] + sum(model["ratio"].get(w, 0.0) for w in words)


def _names(text: Column) -> Column:
    """The maximal runs of letters and digits with a letter in them, lower-cased."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: w.rlike(r"\p{L}"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: list[tuple[list[str], str]] | None = None, url: str = "url", threshold: float = 0.0) -> DataFrame:
    """Add host, path, rule, verdict ("allow" or "block"), block_score (log odds) and host_words.

    A fitting rule decides (the longest); else the method blocks where the log odds exceed `threshold`.
    A null url, or one without `://`, has an empty host and path, fits no rule and is allowed; so is an
    empty host. Repeated rows repeat; an empty table stays empty. Columns named like an output are
    replaced, all others kept.

    `labelled` [(words, "block" or "allow")] is the sample that the model is fitted on, by default the
    fixed one of this module; words that it lacks count for neither side.

    Only distinct names are segmented: unigram counts over all URLs, a table of any size, are joined to
    the substrings of each name (LONGEST_WORD per letter, cut STEP letters at a time and known by the
    name's hash, so that a long name costs in proportion), so no dictionary is broadcast or collected.
    Scores per distinct host and path come back by joins.
    """
    names = ("host", "path", "rule", "verdict", "block_score", "host_words")
    kept = pages.drop(*[c for c in names if c in pages.columns])
    host, path = parts(F.col(url))
    split = kept.withColumn("host", host).withColumn("path", path)
    model = fit_bayes(DEFAULT_LABELLED if labelled is None else labelled)
    listed = {w: LISTED * n for w, n in model["counts"].items()}

    # host labels but the last (the top domain), and path parts, each name with its rows
    labels = F.slice(F.split("host", r"\."), 1, F.greatest(F.size(F.split("host", r"\.")) - 1, F.lit(0)))
    pairs = split.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("n"))
    pairs = durable(pairs.withColumn("names", F.concat(F.flatten(F.transform(labels, _names)), _names(F.col("path")))))
    unigrams = pairs.select(F.explode("names").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("n"))
    unigrams = durable(unigrams.withColumn("of", F.xxhash64("name")))
    total = (unigrams.agg(F.sum("n")).first()[0] or 0) + sum(listed.values()) + 1.0
    first = F.explode(F.sequence(F.lit(0), F.floor((F.length("name") - 1) / STEP).cast("int")))
    cuts = unigrams.select("of", "name", first.alias("nth")).select("of", F.substring("name", F.col("nth") * STEP + 1, F.lit(STEP + LONGEST_WORD - 1)).alias("cut"))
    starts = F.sequence(F.lit(1), F.least(F.length("cut"), F.lit(STEP)))
    from_each = F.transform(starts, lambda i: F.substring("cut", i, F.lit(LONGEST_WORD)))
    shorter = F.transform(from_each, lambda x: F.transform(F.sequence(F.lit(3), F.greatest(F.length(x), F.lit(3))), lambda k: F.substring(x, F.lit(1), k)))
    pieces = cuts.select("of", F.explode(F.array_distinct(F.flatten(shorter))).alias("word")).where(F.length("word") > 2)
    # a name is no evidence for itself as one word: its own count enters only where other names contain it
    counted = unigrams.where(F.length("name").between(3, LONGEST_WORD)).select(F.col("name").alias("word"), "n")
    known = pieces.where(F.xxhash64("word") != F.col("of")).join(counted, "word").groupBy("of").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    known = unigrams.select("name", "of").join(known, "of", "left").select("name", "of", "known")

    def run(batches):
        for batch in batches:
            out = []
            for name, found in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                own = {x["word"]: float(x["n"]) for x in found or []}
                for k in range(len(name)):
                    for m in range(1, LONGEST_WORD + 1):
                        if (w := name[k : k + m]) in listed:
                            own[w] = own.get(w, 0.0)
                out.append(viterbi(name, {w: n + listed.get(w, 0.0) for w, n in own.items()}, total))
            score = [sum(model["ratio"].get(w, 0.0) for w in words) for words in out]
            yield pa.RecordBatch.from_arrays([batch.column("of"), pa.array(out, pa.list_(pa.string())), pa.array(score, pa.float64())], ["of", "words", "score"])

    segmented = known.mapInArrow(run, "of long, words array<string>, score double")
    each = pairs.select("host", "path", F.posexplode_outer("names").alias("nth", "name")).select("host", "path", "nth", F.xxhash64("name").alias("of"))
    scored = each.join(segmented, "of", "left").groupBy("host", "path").agg(
        (F.coalesce(F.sum("score"), F.lit(0.0)) + F.lit(model["prior"])).alias("block_score"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "words"))), lambda x: F.coalesce(x["words"], F.array().cast("array<string>")))).alias("host_words"),
    )
    joined = split.join(scored, ["host", "path"], "left")
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    judged = F.when((F.col("host") != "") & (F.col("block_score") > threshold), F.lit("block")).otherwise(F.lit("allow"))
    return joined.withColumn("__vf_hit", hit).withColumn("rule", F.col("__vf_hit.rule")).withColumn("verdict", F.coalesce(F.col("__vf_hit.verdict"), judged)).select(*kept.columns, *names)
