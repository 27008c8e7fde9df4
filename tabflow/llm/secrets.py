"""Secret scan with a random forest that removes false positives (DataFrame functions and JVM learner only).

Candidates, found in the white-space words of whole texts: values of at least ``MIN_VALUE``
characters behind a credential's name and a sign (``password = ...``, ``"token": ...``,
``api_key=...``), passwords of addresses (``scheme://user:...@host``), and runs of at least
``MIN_LENGTH`` key characters with a digit anywhere.  Features of a candidate: length, character classes and
transitions between them, distinct characters, dictionary coverage (the share of its
letter runs that occur as words of the corpus outside candidates; counted over all documents), the path it
stands in, and neighbouring words (hashed).  A random forest trained on labelled findings
decides which candidates are secrets.

``label_findings`` is the labelling used where a table brings no labels of its own (weak
labels by rule; ambiguous findings stay unlabelled, and any other function may be passed).
At most ``TRAIN_ROWS`` labelled findings (smallest hash) are used for fitting, a bound
given as a parameter.  Dictionary words are counted outside of candidates.

Defined cases: null text has no candidates; a candidate that occurs several times is
reported each time; rows that are equal report equal findings; if the labelled findings
hold fewer than two classes, every candidate gets that class's score; no candidates: an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import row_hash
from tabflow.session import materialize

MIN_LENGTH = 16                         # of a run of key characters anywhere
MIN_VALUE = 6                           # of a value behind a credential's name or in an address
TRAIN_ROWS = 20_000
HASHED = 16                             # hashed places for each neighbouring word
MASK = "[SECRET]"
BROADCAST_ROWS = 500_000
_SPACE = r"[\x20\x09-\x0D]+"
_RUN = rf"[A-Za-z0-9+/_\-]{{{MIN_LENGTH},}}"
#: Names that announce a credential.
_NAMES = r"(?i)(token|secret|passwd|password|api_?key|access_?key|auth|credential|private_?key)"
_SIGN = r"[\"'`]?(=>|:=|==?|:)"
#: ``name=value`` in one word; the end of ``name =``; the password of ``scheme://user:password@host``.
_INSIDE = rf"{_NAMES}\w*{_SIGN}[\"'`]?([^\"'`,;]{{{MIN_VALUE},}})"
_OPEN = rf"{_NAMES}\w*{_SIGN}$"
_ADDRESS = rf"[A-Za-z][A-Za-z0-9+.\-]*://[^/:@]+:([^/@]{{{MIN_VALUE},}})@"
#: Published prefixes and lengths of well-known access keys.
_KNOWN = (r"^((AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}"
          r"|AIza[A-Za-z0-9_\-]{35}|sk-[A-Za-z0-9]{20,})$")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, pos, nth, found, kind, word, before, before2, after) of every candidate; ``kind``: ``value`` behind a
    credential's name, ``address`` (password of an address) or ``run`` of key characters with a digit."""
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), _SPACE)
    rows = docs.select(F.col(id_col).alias("doc_id"), row_hash(id_col, text_col).alias("key"), words.alias("words"))
    near = {n: F.coalesce(F.get("words", F.col("pos") + k), F.lit("")) for n, k in (("before2", -2), ("before", -1), ("after", 1))}
    w, last = F.col("word"), F.substring(near["before"], -1, 1)
    sign = near["before"].isin("=", ":", "=>", ":=", "==")
    behind = (F.length("word") >= MIN_VALUE) & last.isin("=", ":", ">") & F.when(
        sign, near["before2"].rlike(rf"{_NAMES}\w*[\"'`]?$")).otherwise(near["before"].rlike(_OPEN))
    marked = (w.contains("=") | w.contains(":")) & (w.rlike(_INSIDE) | w.rlike(_ADDRESS))
    word = (rows.select("doc_id", "key", "words", F.posexplode("words").alias("pos", "word"))
            .filter(((F.length("word") >= MIN_LENGTH) & w.rlike("[0-9]")) | marked | behind)
            .select("doc_id", "key", "pos", "word", behind.alias("behind"), *[c.alias(n) for n, c in near.items()]))
    bare = F.when(w.rlike(r"^[\"'`]"), F.regexp_extract("word", r"^[\"'`]+([^\"'`]*)", 1)) \
        .otherwise(F.regexp_replace("word", r"^[(\[{]+|[\"'`)\]},;.]+$", ""))
    address = F.regexp_extract("word", _ADDRESS, 1)
    value = F.when(address != "", F.lit("")).when(F.col("behind"), bare).otherwise(
        F.regexp_replace(F.regexp_extract("word", _INSIDE, 3), r"[)\]},;.]+$", ""))
    fits = lambda x: F.length(x) >= MIN_VALUE
    one = lambda kind: lambda x: F.struct(x.alias("found"), F.lit(kind).alias("kind"))
    named = F.concat(F.transform(F.filter(F.array(address), fits), one("address")), F.transform(F.filter(F.array(value), fits), one("value")))
    runs = F.filter(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)),
                    lambda r: r.rlike("[0-9]") & ~F.contains(address, r) & ~F.contains(value, r))
    found = word.select("doc_id", "key", "pos", "word", "before2", "before", "after",
                        F.posexplode(F.concat(named, F.transform(runs, one("run")))).alias("nth", "c"))
    return found.select("doc_id", "key", "pos", "nth", "c.found", "c.kind", "word", "before2", "before", "after")


def _letter_runs(col: str) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z]{3,}"), F.lit(0))


def dictionary(docs: DataFrame, found: DataFrame, text_col: str = "text", least: int = 3) -> DataFrame:
    """(run): letter runs of candidates that occur at least ``least`` times in the corpus outside candidates."""
    runs = found.select(F.explode(_letter_runs("found")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("own"))
    if runs.count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    tokens = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z]+")).alias("run"))
    return (tokens.filter(F.length("run") >= 3).join(runs, "run")
            .groupBy("run").agg((F.count(F.lit(1)) - F.max("own")).alias("n")).filter(F.col("n") >= least).select("run"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``features`` (vector) to candidates."""
    c = F.col("found")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    n = F.length("found").cast("double")

    def share(pattern):
        return (n - F.length(F.regexp_replace(c, pattern, ""))) / n

    run = found.select("key", "pos", "nth", F.explode(F.array_distinct(_letter_runs("found"))).alias("run")).distinct()
    covered = (run.join(words.withColumn("known", F.lit(1)), "run")
               .groupBy("key", "pos", "nth").agg(F.sum(F.length("run")).alias("covered")))
    hashed = [F.when(F.pmod(F.xxhash64(F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))), F.lit(HASHED)) == k, 1.0)
              .otherwise(0.0) for w in ("before2", "before", "after") for k in range(HASHED)]
    around = F.concat_ws(" ", "before2", "before", "word")
    plain = [
        n, F.length("word") - n,
        F.length(F.regexp_replace(shape, r"(.)\1*", "$1")) / n,                 # class transitions
        share("[a-z]"), share("[A-Z]"), share("[0-9]"), share("[g-zG-Z]"), share("[^A-Za-z0-9]"),
        share("[aeiouAEIOU]"), F.size(F.array_distinct(F.split(c, ""))) / n,
        F.least(F.coalesce(F.col("covered"), F.lit(0)) / n, F.lit(1.0)),        # dictionary coverage
        F.col("word").contains("/").cast("double"), F.col("word").contains("@").cast("double"),
        F.length(F.regexp_replace("word", "[^/.]", "")),                        # depth of the path it stands in
        around.rlike("[=:]").cast("double"), around.rlike(_NAMES).cast("double"),
        F.col("word").rlike("^[\"'`]").cast("double"),
        (F.col("kind") == "value").cast("double"), (F.col("kind") == "address").cast("double"),
        c.rlike(_KNOWN).cast("double"), c.rlike("[0-9]").cast("double"),
    ]
    return (found.join(covered, ["key", "pos", "nth"], "left")
            .withColumn("features", array_to_vector(F.array(*[F.coalesce(x.cast("double"), F.lit(0.0))
                                                              for x in plain + hashed])))
            .withColumn("known_share", F.least(F.coalesce(F.col("covered"), F.lit(0)) / n, F.lit(1.0))).drop("covered"))


def label_findings(found: DataFrame) -> DataFrame:
    """Adds ``label`` (1.0, 0.0 or null) by rule: well-known keys and named values that are not made of dictionary words
    are secrets; named values that are, plain short words, numbers, paths, and runs that neither a name nor a known form marks are not;
    the rest (passwords in addresses, runs near a name, for example) stay for the forest to judge."""
    c, around = F.col("found"), F.concat_ws(" ", "before2", "before", "word")
    short = c.rlike("^[A-Z]?[a-z]+$") & (F.length(c) < MIN_LENGTH)
    plain = (F.col("known_share") >= 0.6) | short | c.rlike("^[0-9_+/.:\\-]+$") | c.rlike("^(https?|file|/|\\$|<|%)")
    value = F.col("kind") == "value"
    return found.withColumn("label", F.when(c.rlike(_KNOWN), 1.0).when(value & plain, 0.0)
                            .when(value & (F.col("known_share") <= 0.2), 1.0).when(value, F.lit(None).cast("double"))
                            .when(F.col("kind") == "address", F.when(~plain, 1.0))
                            .when(c.rlike("^[0-9_+/\\-]+$") | F.col("word").rlike("@|://|^/"), 0.0)
                            .when(~(around.rlike("[=:]") & around.rlike(_NAMES)), 0.0))


def scan(docs: DataFrame, labelled=label_findings, threshold: float = 0.5, train_rows: int = TRAIN_ROWS,
         trees: int = 20, depth: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored candidates with ``score`` (the forest's probability) and ``is_secret``; ``labelled`` adds a ``label``
    column to candidates (null: not labelled)."""
    found = materialize(candidates(docs, id_col, text_col))
    rows = materialize(labelled(features(found, dictionary(docs, found, text_col))))
    sample = materialize(rows.filter(F.col("label").isNotNull())
                         .orderBy(F.xxhash64("key", "pos", "nth"), "key", "pos", "nth").limit(train_rows)
                         .select("label", "features"))
    classes = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        scored = rows.withColumn("score", F.lit(classes[0] if classes else 0.0))
    else:
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird")
        scored = forest.fit(sample).transform(rows).withColumn("score", vector_to_array("probability")[1])
    return (scored.withColumn("is_secret", F.col("score") >= threshold)
            .select("doc_id", "key", "pos", "nth", "found", "score", "is_secret"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every found secret masked in its text (``n_chars``, if there, follows); columns as given."""
    secrets = (scan(docs, id_col=id_col, text_col=text_col, **options).filter("is_secret")
               .groupBy(F.col("key").alias("_key")).agg(F.collect_set("found").alias("_found"))
               # longer ones first, so that one inside another is masked with it
               .withColumn("_found", F.transform(F.array_sort(F.transform(
                   "_found", lambda s: F.struct(-F.length(s), s.alias("s")))), lambda x: x["s"])))
    joined = docs.withColumn("_row", row_hash(id_col, text_col)).join(secrets, F.col("_row") == F.col("_key"), "left")
    masked = F.when(F.col("_found").isNull(), F.col(text_col)).otherwise(
        F.aggregate("_found", F.col(text_col), lambda t, s: F.replace(t, s, F.lit(MASK))))
    out = joined.withColumn(text_col, masked)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_found").isNull(), F.col("n_chars"))
                             .otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
