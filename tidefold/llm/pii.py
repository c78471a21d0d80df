r"""PII: information-theoretic sanitisation in built-in functions only.

Base entities (email, ip, card, phone) are protected. A term that co-occurs with an entity reveals it as far
as the corpus says so: with document frequencies over all documents, PMI(c; t) = log(df(c,t) N / (df(c) df(t)))
against the entity's own information IC(c) = log(N / df(c)). Documents are dealt into blocks of BLOCK code points; a
term co-occurs with an entity in a document that holds both in the same block or in neighbouring ones, so texts
of up to BLOCK code points are one context, and the candidate pairs of a longer one stay in proportion to its length.
A term is generalised, wherever it stands in a document that mentions c, when PMI >= disclosure * IC and the pair is seen
in at least min_support documents of different texts and, so that near copies of one text are hardly evidence, of
different least word hashes. A term is a run of letters and digits outside all mentions, in lower case.

Null texts count as empty. Rows are keyed by doc_id (nulls equal nulls) and a hash of the text, so repeated rows count
as one document and get equal results. Columns other than doc_id and text are left out by pii() and kept by sanitised().
An empty table gives an empty result. Very long texts: patterns are matched by possessive loops without rescanning, spans
and masks go through folds of 512 elements, and entities of fewer than min_support documents have no candidates at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import let, matches, own_key, same_row, scanned, spans_if, spans_of, staged, tagged, unused

KINDS = ("email", "ip", "card", "phone", "term")
#: Code points of a block; a term co-occurs with the mentions of its own and both neighbouring blocks.
BLOCK = 2000
MIN_SUPPORT, DISCLOSURE = 3, 0.9
#: Up to so many candidate terms are broadcast; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 200_000

# \G or a non-member before: the same leftmost matches as the plain pattern, without rescanning long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_PARTS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
WORD = r"[\p{L}\p{N}]++"
#: Mentions are taken as one token, so that their parts are not terms.
TOKEN = f"{EMAIL}|{PHONE}|{IP}|{CARD}|{WORD}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's checksum; the length is checked before, so at most 19 digits come here."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    worth = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(x: Column, _: Column) -> Column:
    d = _digits(x)
    return F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))


def base_spans(text: Column, of=spans_of) -> dict[str, Column]:
    """The protected entities by kind; of: spans_of for their places, matches for their wording too."""
    return {
        "email": spans_if(F.contains(text, F.lit("@")), of(text, EMAIL), of),
        "ip": spans_if(text.rlike(IP), of(text, IP, keep=lambda x, _: x.rlike(IP_PARTS)), of),
        "card": spans_if(text.rlike(CARD), of(text, CARD, keep=_card), of),
        "phone": spans_if(F.contains(text, F.lit("+")), of(text, PHONE, keep=lambda x, _: F.char_length(_digits(x)).between(9, 15)), of),
    }


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))


def _found(texts: DataFrame) -> DataFrame:
    """doc_id, h, base (tagged spans, by kind and start), ents (the mentions' entities) and, where there are any, the text t; staged."""
    some = base_spans(F.col("t"), matches)
    norm = lambda k, w: F.concat(F.lit(f"{k}:"), _digits(w) if k in ("card", "phone") else F.lower(w))
    rows = F.concat(*(F.transform(some[k], lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(k)).alias("o"), x["e"].alias("e"), F.lit(k).alias("k"), norm(k, x["w"]).alias("ent"))) for k in KINDS[:4]))
    rows = texts.select("doc_id", "h", "t", rows.alias("rows"))
    span = F.transform("rows", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["k"].alias("k")))
    return staged(rows.select("doc_id", "h", span.alias("base"), F.transform("rows", lambda x: x["ent"]).alias("ents"), F.when(F.size("rows") > 0, F.col("t")).alias("t")), "pii-found")


def contexts(found: DataFrame, min_support: int = MIN_SUPPORT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (ent2, df_c) seen in min_support documents or more; their mentions (doc_id, h, ent, block); and the terms
    (doc_id, h, block, term, s, e, sketch) of the documents that mention one, sketch being the text's least word hash."""
    mention = found.select("doc_id", "h", F.explode(F.arrays_zip("base", "ents")).alias("m")).select("doc_id", "h", F.col("m.ents").alias("ent"), F.floor(F.col("m.base.s") / BLOCK).cast("int").alias("block")).distinct()
    once = mention.select("doc_id", "h", "ent").distinct().groupBy("ent").agg(F.count(F.lit(1)).alias("df_c")).filter(F.col("df_c") >= min_support)
    ents = staged(once.select(own_key("ent").alias("ent2"), "df_c"), "pii-entities")
    mention = staged(mention.join(ents, mention["ent"] == ents["ent2"]).drop("ent2", "df_c"), "pii-mentions")
    held = mention.select(F.col("doc_id").alias("doc_id2"), F.col("h").alias("h2")).distinct()
    texts = found.filter(F.size("base") > 0).join(held, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("h") == F.col("h2")), "left_semi").dropDuplicates(["doc_id", "h"])
    tokens = F.filter(matches(F.col("t"), TOKEN), lambda x: x["w"].rlike(f"^{WORD}$"))
    words = F.transform(tokens, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lower(x["w"]).alias("w")))
    # the sketch goes into each element: beside the explosion it would be worked out again for every word
    least = lambda ws: F.array_min(F.transform(ws, lambda x: F.xxhash64(x["w"])))
    each = lambda ws, m: F.transform(ws, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["w"].alias("w"), m.alias("m")))
    words = texts.select("doc_id", "h", F.explode(let(words, lambda ws: let(least(ws), lambda m: each(ws, m)))).alias("x"))
    words = words.select("doc_id", "h", F.floor(F.col("x.s") / BLOCK).cast("int").alias("block"), F.col("x.w").alias("term"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("sketch"))
    return ents, mention, staged(words, "pii-words")


def disclosing(texts: DataFrame, ents: DataFrame, mention: DataFrame, words: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """ent, term, df_ct, df_c, df_t, pmi, ic: the pairs whose term reveals the entity."""
    near = mention.select(F.col("doc_id").alias("doc_id2"), F.col("h").alias("h2"), "ent", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).alias("block2")).distinct()
    terms = words.select("doc_id", "h", "block", "term", "sketch").distinct()
    n = texts.select("doc_id", "h").distinct().count()
    log = lambda x: F.log(x.cast("double"))
    log_n = F.log(F.lit(float(max(n, 1))))
    ic = log_n - log(F.col("df_c"))
    pmi = lambda df_t: log(F.col("df_ct")) + log_n - log(F.col("df_c")) - log(F.col(df_t))
    # a term occurs in at least the documents it was seen in here, so no entity can make up for so many: it loses no pair
    seen = terms.select("doc_id", "h", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
    most = ents.agg(F.max("df_c")).first()[0]
    if most is None:
        return ents.select(F.col("ent2").alias("ent"), F.lit("").alias("term"), *(F.lit(0).cast("long").alias(c) for c in ("df_ct", "df_c", "df_t")), F.lit(0.0).alias("pmi"), F.lit(0.0).alias("ic")).limit(0)
    # PMI >= disclosure * IC and df_ct <= df_c give df_t <= df_c * (N / df_c) ** (1 - disclosure), which grows with df_c
    reach = most * (n / most) ** (1 - disclosure) * (1 + 1e-9)
    rare = seen.filter((F.col("seen") >= min_support) & (F.col("seen") <= reach)).select(own_key("term").alias("term2"), "seen")
    terms = terms.join(rare, terms["term"] == rare["term2"]).drop("term2")
    pairs = terms.join(near, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("h") == F.col("h2")) & (F.col("block") == F.col("block2")))
    pairs = pairs.groupBy("ent", "term", "doc_id", "h").agg(F.min("sketch").alias("sketch"), F.first("seen").alias("seen"))
    pairs = pairs.groupBy("ent", "term").agg(F.count(F.lit(1)).alias("df_ct"), F.countDistinct("h").alias("n_texts"), F.countDistinct("sketch").alias("n_sketches"), F.first("seen").alias("seen"))
    pairs = pairs.filter((F.col("n_texts") >= min_support) & (F.col("n_sketches") >= min_support))
    known = pairs.join(ents, pairs["ent"] == ents["ent2"]).drop("ent2")
    known = staged(known.filter((ic > 0) & (pmi("seen") >= disclosure * ic - 1e-9)).drop("seen"), "pii-pairs")
    wanted = known.select("term").distinct()
    n_terms = wanted.count()
    split = F.array_distinct(F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    held = texts.select("doc_id", "h", F.explode(split).alias("term")) if n_terms else texts.select("doc_id", "h", F.lit("").alias("term")).limit(0)
    held = held.join(F.broadcast(wanted) if n_terms <= BROADCAST_TERMS else wanted, "term", "left_semi")
    df_t = held.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df_t")).select(own_key("term").alias("term2"), "df_t")
    known = known.join(df_t, known["term"] == df_t["term2"]).drop("term2")
    return known.withColumns({"pmi": pmi("df_t"), "ic": ic}).filter(F.col("pmi") >= disclosure * F.col("ic") - 1e-9)


def term_spans(texts: DataFrame, found: DataFrame, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, h, terms: the spans (s, o, e, k) of disclosing terms, one row for each document that has some."""
    ents, mention, words = contexts(found, min_support)
    reveal = staged(disclosing(texts, ents, mention, words, min_support, disclosure).select(F.col("ent").alias("ent2"), "term"), "pii-disclosing")
    said = mention.select("doc_id", "h", "ent").distinct()
    said = said.join(reveal, said["ent"] == reveal["ent2"]).select(F.col("doc_id").alias("doc_id2"), F.col("h").alias("h2"), F.col("term").alias("term2")).distinct()
    hit = words.join(said, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("h") == F.col("h2")) & (F.col("term") == F.col("term2")), "left_semi")
    span = F.struct(F.col("s"), F.lit(4).alias("o"), F.col("e"), F.lit("term").alias("k"))
    return hit.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(span)).alias("terms"))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base and all (spans by kind, then start)."""
    texts = _texts(docs)
    found = _found(texts)
    terms = term_spans(texts, found)
    count = lambda i: F.size(F.filter("base", lambda x: x["o"] == i)).cast("bigint")
    found = found.select("doc_id", "h", *(count(i).alias(f"n_{KINDS[i]}") for i in range(4)), "base")
    both = found.join(terms, same_row(found, terms), "left").select(found["*"], terms["terms"])
    return both.withColumn("all", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", "terms")))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; overlapping spans merge into the first one's."""

    def stretch(at: Column, block: Column) -> Column:
        upto = F.array_max(F.transform(block, lambda x: x["e"]))
        return F.struct(at.alias("at"), F.substring(text, at + 1, F.greatest(upto - at, F.lit(0))).alias("t"))

    def step(at: Column, x: Column, w: Column):
        piece = F.concat(F.substring(w["t"], at - w["at"] + 1, F.greatest(x["s"] - at, F.lit(0))), F.lit("<"), F.upper(x["k"]), F.lit(">"))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, F.array(piece)).otherwise(F.array().cast("array<string>"))

    whole = scanned(F.array_sort(spans), F.lit(0), "array<string>", step, stretch)
    return let(whole, lambda x: F.concat(F.array_join(x["out"], ""), F.substring(text, x["at"] + 1, F.char_length(text))))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with text masked where spans were found; n_chars, if there, follows. Other rows and columns stay, whatever their names."""
    base, key, h, term = unused(docs, "__base", "__id", "__h", "__terms")
    texts = _texts(docs)
    terms = term_spans(texts, _found(texts)).select(F.col("doc_id").alias(key), F.col("h").alias(h), F.col("terms").alias(term))
    spans = base_spans(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn(base, F.concat(*(tagged(spans[k], k, KINDS.index(k)) for k in KINDS[:4])))
    found, clean = rows.filter(F.size(base) > 0), rows.filter(F.size(base) == 0).drop(base)
    joined = found.join(terms, found["doc_id"].eqNullSafe(terms[key]) & (F.xxhash64(found["text"]) == terms[h]), "left")
    all_spans = F.concat(base, F.coalesce(term, F.array().cast("array<struct<s:int,o:int,e:int,k:string>>")))
    done = joined.withColumn("text", masked(F.col("text"), all_spans))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns).unionByName(clean.select(*docs.columns))
