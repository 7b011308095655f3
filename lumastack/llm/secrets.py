"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumastack.llm.shared import materialise

#: The patterns, the group that holds the secret, and the least length of it.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: For hex and access runs a length in the pattern finds the same matches as dropping short ones, without listing those.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


#: What the method adds to the base kinds: the characters of a secret that only few owners hold.
LIVE = "live"
#: Code points of the parts that a text with secrets to cut out is taken apart in.
PART = 1024


def matches_of(text: Column, kind: str) -> Column:
    """Array of (kind number, k, gap, size, least, secret_size, sha): the k-th match of a kind, leftmost and not overlapping, with the
    code points of the match, of the text before it back to the match before, and of its secret, and the secret's hash."""
    pattern, group, least = KINDS[kind]
    pattern = FAST.get(kind, pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(matches.alias("match"), F.split(text, pattern, -1).alias("gap"), secrets.alias("secret"))

    def one(p: Column, k: Column) -> Column:
        return F.struct(F.lit(list(KINDS).index(kind)).alias("kind"), k.alias("k"), F.length(p["gap"]).alias("gap"), F.length(p["match"]).alias("size"), (F.length(p["secret"]) >= least).alias("enough"), F.length(p["secret"]).alias("secret_size"), F.sha2(p["secret"], 256).alias("sha"))

    # the text after the last match is a gap without a match
    none = F.expr("cast(array() as array<struct<kind:int,k:int,gap:int,size:int,enough:boolean,secret_size:int,sha:string>>)")
    return F.when(F.size(matches) > 0, F.transform(F.filter(parts, lambda p: p["match"].isNotNull()), one)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None) -> DataFrame:
    """(id, owner, repo, text_hash, matches): all matches of every document, the short ones too, by kind and place.

    Without a repo column, or where it is null, each distinct text counts as a repository; without an owner column a repository is its own owner.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    repo = F.coalesce(F.col(repo_col).cast("string"), F.md5(text)) if repo_col else F.md5(text)
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")) if owner_col else repo
    return docs.select(F.col(id_col).alias("id"), owner.alias("owner"), repo.alias("repo"), F.md5(text).alias("text_hash"), F.concat(*[matches_of(text, k) for k in KINDS]).alias("matches"))


def spans_of(found: DataFrame) -> DataFrame:
    """(text_hash, start, kind, end, secret_start, sha) of every match that is long enough, from scan.

    A match's place is the sum of what stands before it, so spans follow from the text alone and are made once for each
    distinct text that has any. Sums run in a window over the rows of a text and kind, linear in the matches.
    """
    rows = found.where(F.size("matches") > 0).select("text_hash", "matches").groupBy("text_hash").agg(F.first("matches").alias("matches")).select("text_hash", F.explode("matches").alias("m")).select("text_hash", "m.*")
    upto = Window.partitionBy("text_hash", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    return ends.where("enough").select("text_hash", (F.col("end") - F.col("size")).alias("start"), "kind", "end", (F.col("end") - F.col("secret_size")).alias("secret_start"), "sha")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, shared_owners: int = 3) -> DataFrame:
    """One row per document with `spans`: array of (start, kind, end, sha, repos, owners, live), by start, then kind.

    Kinds 0 to 2 are the base kinds, with every match. Kind 3 (`live`) is what the method adds: the characters of a secret
    that looks live, once if several base spans hold it.

    Corpus-wide ownership: hashes of the secrets are counted by distinct owners, and by distinct repositories of each owner,
    combined before the shuffle. A secret that at least shared_owners owners hold is a widely copied example; one that
    fewer hold looks live. The scan is stored, without texts and secrets, so texts are read once; spans and counts are
    joined back by hash, and Spark splits a hash that very many documents hold.

    A null text counts as empty. A null owner counts as an owner of its own; repositories as in scan. Rows that repeat id
    and text keep a row each, with the same spans, and count once. The work is linear in the matches of a document. Other
    columns play no part.
    """
    found = materialise(scan(docs, id_col, text_col, owner_col, repo_col))
    spans = materialise(spans_of(found))
    holders = found.where(F.size("matches") > 0).select("text_hash", "owner", "repo").distinct()
    held = spans.select("text_hash", "sha").distinct().join(holders, "text_hash").select("sha", "owner", "repo").distinct().groupBy("sha", "owner").agg(F.count("*").alias("n"))
    owned = held.groupBy("sha").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))
    live = F.col("owners") < shared_owners
    facts = (F.col("sha"), F.col("repos"), F.col("owners"), live.alias("live"))
    base = F.struct("start", "kind", "end", *facts)
    added = F.struct(F.col("secret_start").alias("start"), F.lit(len(KINDS)).alias("kind"), "end", *facts)
    each = spans.join(owned, "sha").select("text_hash", F.explode(F.when(live, F.array(base, added)).otherwise(F.array(base))).alias("s"))
    per_text = materialise(each.groupBy("text_hash").agg(F.array_sort(F.collect_set("s")).alias("spans")))
    none = F.expr(f"cast(array() as {dict(per_text.dtypes)['spans']})")
    return found.select("id", "text_hash").join(per_text, "text_hash", "left").select(F.col("id").alias(id_col), "text_hash", F.coalesce("spans", none).alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, LIVE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(texts: DataFrame, cuts: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """(key, text) of the rows of texts (key, text: one row a key) that have cuts (key, start, end), with mark in place of every cut; cuts that overlap are one.

    A text is taken apart in PART code points, each part loses its cuts, and the parts are put together again, so the work is
    linear in the text and its cuts.
    """
    order = Window.partitionBy("key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = cuts.select("key", "start", "end", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int").alias("new"))
    whole = new.withColumn("n", F.sum("new").over(order)).groupBy("key", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    by_part = whole.select("key", "start", "end", F.explode(F.sequence(F.expr(f"start div {PART}"), F.expr(f"(end - 1) div {PART}"))).alias("part"))
    own = by_part.select("key", F.col("part").cast("int").alias("part"), F.struct((F.col("start") - F.col("part") * PART).cast("int").alias("a"), (F.col("end") - F.col("part") * PART).cast("int").alias("b")).alias("cut")).groupBy("key", "part").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    parts = texts.join(cuts.select("key").distinct(), "key", "left_semi").select("key", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % PART), F.lit(0))).alias("part", "text"))

    def step(held: Column, cut: Column) -> Column:
        before = F.substring(F.col("text"), held["at"] + 1, F.greatest(F.lit(0), cut["a"] - held["at"]))
        return F.struct(F.least(cut["b"], F.lit(PART)).alias("at"), F.concat(held["out"], before, F.when(cut["a"] >= 0, F.lit(mark)).otherwise("")).alias("out"))

    done = F.aggregate("cuts", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda held: F.concat(held["out"], F.substring(F.col("text"), held["at"] + 1, F.lit(PART))))
    cut = parts.join(own, ["key", "part"], "left").select("key", F.struct("part", F.coalesce(done, F.col("text")).alias("text")).alias("p"))
    return cut.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], "").alias("text"))
