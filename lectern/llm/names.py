"""Linking the spellings of people's and organisations' names.

Each distinct spelling is read into a kind, a family name or an organisation's own name (the anchor), and further
words.  Tokens that differ by one edit meet in a symmetric-delete index (a token and all its forms with one letter
less); the rarer one is taken for a misspelling of the far more frequent one.  Nicknames are learned from spellings
that quote them and completed from a small list.  Names in reverse order without a comma are turned where both of their
words mostly stand in the other place.  Spellings with a full given name are then grouped by their repaired words; where
a family has several people of one given name that differ in the middle name, those stay apart.  Spellings of initials
and abbreviations are aligned to the full names of the same family by an optimal assignment of words, and linked to the
one entity that fits best.

Only distinct tokens and spellings are ever joined; books meet the finished map.  A token shares a form with no more
tokens than there are letters to lose or replace, so no key of the index is hot.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.session import durable

# Words around a name that are no part of it.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md msc bsc ma mba dphil jr sr ed eds editor by edited written the von dr-ing hon rev".split()) - {"the", "von"}
# Words of which a filler consists that names nobody.
FILLERS = frozenset(
    "n a na unknown anonymous anon various authors author several multiple misc none null tbd tba nil nobody unnamed editors editorial "
    "compendium staff team board collective contributors others et al and see cover unbekannt divers unspecified not available given".split()
)
# Kinds of organisations with their abbreviations.
KINDS = {
    "department": "dept dep", "institute": "inst", "association": "assoc assn", "foundation": "found fdn fndn", "consortium": "cons consort",
    "laboratory": "lab labs", "group": "grp", "university": "univ", "society": "soc", "committee": "comm", "company": "co", "corporation": "corp",
    "centre": "center ctr", "college": "coll", "academy": "acad", "agency": "agcy", "council": "", "union": "", "press": "", "organisation": "organization org",
}
LEGAL = frozenset("ltd inc llc gmbh plc ag sa bv co limited incorporated the of for and".split())
# Common English nicknames.
NICKNAMES = {
    "bob": "robert", "ollie": "oliver", "olly": "oliver", "rob": "robert", "bobby": "robert", "robbie": "robert", "bill": "william", "will": "william", "billy": "william", "liam": "william",
    "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "mike": "michael", "mick": "michael", "mickey": "michael", "nick": "nicholas", "nicky": "nicholas", "chris": "christopher", "kit": "christopher", "tom": "thomas", "tommy": "thomas",
    "ted": "edward", "ed": "edward", "eddie": "edward", "ned": "edward", "theo": "theodore", "alex": "alexander", "sandy": "alexander", "sasha": "alexander",
    "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "marge": "margaret",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kitty": "katherine", "sam": "samantha", "debbie": "deborah", "deb": "deborah", "trish": "patricia", "pat": "patricia", "patty": "patricia",
    "vicky": "victoria", "vic": "victoria", "tori": "victoria", "fran": "francesca", "jo": "josephine", "josie": "josephine", "bella": "isabella", "izzy": "isabella", "gabe": "gabriel",
    "jon": "jonathan", "johnathan": "jonathan", "len": "leonard", "leo": "leonard", "lenny": "leonard", "zach": "zachary", "zack": "zachary", "zhenya": "yevgenia", "valya": "valentina", "val": "valentina",
    "steve": "stephen", "dave": "david", "dan": "daniel", "danny": "daniel", "ben": "benjamin", "joe": "joseph", "tony": "anthony", "andy": "andrew", "harry": "henry", "hank": "henry", "hal": "henry",
    "etta": "henrietta", "hettie": "henrietta", "sue": "susan", "jenny": "jennifer", "jen": "jennifer", "becky": "rebecca", "ros": "rosalind", "roz": "rosalind", "matt": "matthew", "greg": "gregory", "ken": "kenneth",
}
_KIND_OF = {form: kind for kind, forms in KINDS.items() for form in [kind, *forms.split()]}
#: A token so much rarer than one an edit away is its misspelling.
RARER = 0.25


def plain(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))


def read(author: str) -> tuple[str, str, list[str], str | None, str | None]:
    """``(kind, anchor, words, nickname, given)`` of a spelling; kind is person, org or none (a filler).

    A person's words are given names or initials in order; an organisation's are its further words and its kind.
    """
    text = plain(author).replace("’", "'")
    quoted = re.search(r"[\"“”„«»]\s*([^\"“”„«»]+?)\s*[\"“”„«»]", text)
    nickname = quoted[1].lower() if quoted else None
    if quoted:
        text = text.replace(quoted[0], " ")
    text = re.sub(r"\([^)]*\)", " ", text)
    # A full stop stays with an abbreviation of a given name; initials and titles need none.
    tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)*(?:(?<=\w\w)\.(?=\s*(?:[\w,]|$)))?|[,:]", text.replace("-", " "))
    tokens = [t.rstrip(".") if t.rstrip(".").lower() in TITLES or t.rstrip(".").lower() in _KIND_OF or t.rstrip(".").lower() in LEGAL or t.rstrip(".").lower() in FILLERS else t for t in tokens]
    words = [t for t in tokens if t not in ",:"]
    low = [w.lower().rstrip(".") for w in words]
    if not low or all(w in FILLERS or len(w) == 1 and not w.isalpha() for w in low):
        return "none", "", [], None, None
    if any(w in _KIND_OF for w in low) and len([w for w in low if w not in LEGAL]) > 1:
        rest = [_KIND_OF.get(w, w) for w in low if w not in LEGAL]
        return "org", "", sorted(rest), None, None
    # A family name with bare initials, before "MA" or "JR" can be taken for a title.
    bare = re.fullmatch(r"\s*(?:by\s+)?([^\W\d_][\w'’-]*[^\W\d_A-Z][\w'’-]*)\s+([A-Z]{1,3})\s*", text)
    if bare:
        return "person", bare[1].lower().replace("-", " "), list(bare[2].lower()), nickname, None
    # Titles go, with the commas that set them off.
    kept = [t for t in tokens if t.lower() not in TITLES and t != ":"]
    while kept and kept[-1] == ",":
        kept.pop()
    if "," in kept:
        at = kept.index(",")
        family, given = [t for t in kept[:at] if t != ","], [t for t in kept[at + 1 :] if t != ","]
    elif len(kept) >= 2 and len(kept[-1]) <= 3 and kept[-1].isupper() and not kept[0].isupper() and len(kept[0]) > 1:
        family, given = kept[:-1], list(kept[-1])
    else:
        family, given = kept[-1:], kept[:-1]
    if not family or sum(map(len, family)) < 2:
        return "none", "", [], None, None
    given = [g.lower() for g in given]
    return "person", " ".join(family).lower().replace(".", ""), given, nickname, next((g for g in given if len(g) > 1 and g[-1] != "."), None)


def one_edit(a: str, b: str) -> bool:
    """Whether two strings differ by one inserted, lost, replaced or swapped letter."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i + 1 : i + 2] + b[i : i + 1] and a[i + 2 :] == b[i + 2 :])


def assigned(scores: list[list[float]]) -> list[int]:
    """The column of each row in the one-to-one assignment with the highest sum; no more rows than columns.

    Shortest augmenting paths with potentials (the Hungarian method): any number of words, in cubic time.
    """
    n, m = len(scores), len(scores[0]) if scores else 0
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[at] = True
            row, step, to = owner[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -scores[row - 1][j - 1] - u[row] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
            if not owner[at]:
                break
        while at:
            owner[at] = owner[way[at]]
            at = way[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def align(short: list[str], full: list[str]) -> float:
    """Best assignment of the words of one name to those of another, with initials and abbreviations; 0 if one clashes.

    Every word of the shorter name must fit a word of its own: equal counts 1, an initial or an abbreviation (with its
    full stop) 0.8, a little less the farther it stands from the place of its word.
    """
    if len(short) > len(full):
        short, full = full, short
    if not short:
        return 0.0

    def fit(a: str, b: str) -> float:
        if a == b:
            return 1.0
        a, b = sorted((a, b), key=lambda w: len(w.rstrip(".")))
        return 0.8 if (len(a) == 1 or a[-1] == ".") and b.startswith(a.rstrip(".")) else 0.0

    fits = [[fit(a, b) for b in full] for a in short]
    # A clash costs more than any other word can gain.
    scores = [[f - 0.05 * abs(i - j) / len(full) if f else -2.0 * len(full) for j, f in enumerate(row)] for i, row in enumerate(fits)]
    chosen = assigned(scores)
    if any(not fits[i][j] for i, j in enumerate(chosen)):
        return 0.0
    return sum(scores[i][j] for i, j in enumerate(chosen)) / len(chosen)


def repaired(tokens: DataFrame) -> DataFrame:
    """``(token, target)`` for misspelled tokens, out of ``(token, n)``."""

    def deletions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for token, n in zip(pdf["token"], pdf["n"], strict=True):
                forms = {token} | ({token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 2 else set())
                out += [(form, token, n) for form in forms]
            yield pd.DataFrame(out, columns=["form", "token", "n"]).astype({"form": "str", "token": "str", "n": "int64"})

    index = tokens.where(F.length("token") >= 3).mapInPandas(deletions, "form string, token string, n bigint")
    index = durable(index, "deletions")
    # Of the tokens that share a form only those with a much more frequent one go on.
    both = (
        index.alias("x").join(index.alias("y"), "form")
        .where((F.col("x.token") != F.col("y.token")) & (F.greatest(F.length("x.token"), F.length("y.token")) >= 4))
        .where((F.col("x.n") <= F.greatest(F.lit(1.0), RARER * F.col("y.n"))) & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.token") > F.col("y.token")))))
        .select(F.col("x.token").alias("token"), F.col("y.token").alias("target"), F.col("y.n").alias("n")).distinct()
    )
    check = F.pandas_udf(lambda a, b: pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype="bool"), "boolean")
    best = W.partitionBy("token").orderBy(F.desc("n"), "target")
    return both.where(check("token", "target")).withColumn("rn", F.row_number().over(best)).where("rn = 1").select("token", "target")


def entities(authors: DataFrame) -> DataFrame:
    """``(author, entity)`` for each distinct spelling of ``authors`` (one string column); fillers and nulls have no row.

    Equal entities are the same person or organisation.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(a, *read(a)) for a in pdf["author"]]
            frame = pd.DataFrame(rows, columns=["author", "kind", "anchor", "words", "nickname", "given"])
            yield frame[frame["kind"] != "none"]

    spelled = authors.select("author").where("author is not null").distinct()
    names = durable(spelled.mapInPandas(parse, "author string, kind string, anchor string, words array<string>, nickname string, given string"), "names")

    # A name without a comma whose two words mostly stand in each other's place is in reverse order.
    roles = names.where("kind = 'person'").select(F.explode(F.array(F.struct(F.col("anchor").alias("token"), F.lit(1).alias("f")), F.struct(F.col("given").alias("token"), F.lit(0).alias("f")))).alias("r"))
    roles = roles.select("r.*").where("token is not null").groupBy("token").agg(F.sum("f").alias("f"), F.count("*").alias("n")).withColumn("lean", 2 * F.col("f") - F.col("n"))
    two = names.where("kind = 'person' and size(words) = 1 and given is not null and not contains(author, ',')")
    turned = (
        two.select("author", F.col("given").alias("new_anchor"), F.col("anchor").alias("new_given"))
        .join(roles.select(F.col("token").alias("new_anchor"), F.col("lean").alias("a")), "new_anchor")
        .join(roles.select(F.col("token").alias("new_given"), F.col("lean").alias("g")), "new_given")
        .where("a > 0 and g < 0")
        .select("author", "new_anchor", "new_given")
    )
    names = names.join(turned, "author", "left").withColumns(
        {
            "anchor": F.coalesce("new_anchor", "anchor"),
            "words": F.when(F.col("new_given").isNotNull(), F.array("new_given")).otherwise(F.col("words")),
            "given": F.coalesce("new_given", "given"),
        }
    ).drop("new_anchor", "new_given")
    names = durable(names, "ordered")

    counted = lambda df: df.groupBy("token").agg(F.count("*").alias("n"))
    anchors = repaired(counted(names.where("kind = 'person'").select(F.col("anchor").alias("token"))))
    givens = repaired(counted(names.where("kind = 'person'").select(F.explode("words").alias("token")).where("length(token) > 1 and not endswith(token, '.')")))
    org_words = repaired(counted(names.where("kind = 'org'").select(F.explode("words").alias("token"))))

    # Nicknames quoted in spellings: a nickname with one formal name; the small list completes them.
    learned = (
        names.where("nickname is not null and given is not null and nickname != given and length(given) > 1")
        .groupBy("nickname", "given").agg(F.count("*").alias("n"))
    )
    pick = W.partitionBy("nickname").orderBy(F.desc("n"), "given")
    learned = learned.withColumn("rn", F.row_number().over(pick)).where("rn = 1").select(F.col("nickname").alias("nick"), F.col("given").alias("formal"))
    listed = names.sparkSession.createDataFrame(sorted(NICKNAMES.items()), "nick string, formal string")
    nicknames = learned.unionByName(listed.join(learned, "nick", "left_anti"))

    # Organisations: the repaired words, whatever their order.
    orgs = names.where("kind = 'org'").select("author", F.posexplode("words").alias("at", "token")).join(org_words, "token", "left")
    orgs = orgs.groupBy("author").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("target", "token"))), " ").alias("key"))
    orgs = orgs.select("author", F.concat(F.lit("org "), "key").alias("entity"))

    people = names.where("kind = 'person'").join(anchors.select(F.col("token").alias("anchor"), F.col("target").alias("family")), "anchor", "left")
    people = people.select("author", F.coalesce("family", "anchor").alias("family"), "words")
    words = (
        people.select("author", F.posexplode("words").alias("at", "token"))
        .join(givens, "token", "left").withColumn("token", F.coalesce("target", "token")).drop("target")
        .join(nicknames.withColumnRenamed("nick", "token"), "token", "left").withColumn("token", F.coalesce("formal", "token"))
        .groupBy("author").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("given"))
    )
    people = durable(people.drop("words").join(words, "author", "left").withColumn("given", F.coalesce("given", F.array().cast("array<string>"))), "people")
    first = F.get(F.filter("given", lambda g: (F.length(g) > 1) & ~g.endswith(".")), F.lit(0))
    people = people.withColumn("first", F.when(F.size("given") > 0, first))
    initial = F.when(F.size("given") > 0, F.substring(F.get("given", F.lit(0)), 1, 1))
    middle = F.substring(F.get(F.filter("given", lambda g: g != F.col("first")), F.lit(0)), 1, 1)
    full = people.where("first is not null").select("author", "family", "first", middle.alias("middle"))
    # People of one name with several middle names stay apart; a spelling without one is then nobody's among them.
    middles = full.groupBy("family", "first").agg(F.array_sort(F.collect_set("middle")).alias("middles"))
    full = full.join(middles, ["family", "first"]).withColumn("own", F.when(F.size("middles") > 1, F.coalesce("middle", F.lit(""))))
    full = durable(full, "full")
    named = F.concat_ws(" ", F.lit("person"), "family", "first", F.nullif("own", F.lit("")))
    resolved = full.select("author", named.alias("entity"))

    # Initials and abbreviations: the full name of the family that the words align with, if there is just one best.
    letters = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(F.array_join("middles", ""))
    known = full.select("family", "first", letters.alias("middles"), named.alias("entity")).distinct().withColumn("letter", F.substring("first", 1, 1))
    short = people.where("first is null").select("author", "family", "given", initial.alias("letter"))
    score = F.pandas_udf(_initials_score, "double")
    fits = (
        short.select("author", "family", "given", "letter").join(known, ["family", "letter"])
        .withColumn("score", score("given", "first", "middles")).where("score > 0")
    )
    fits = durable(fits, "fits")
    rank = W.partitionBy("author").orderBy(F.desc("score"), "entity")
    best = fits.withColumns({"rn": F.row_number().over(rank), "next": F.lead("score").over(rank)})
    best = best.where("rn = 1 and (next is null or next < score)").select("author", "entity")
    # Initials that fit no full name are an entity by family and first letter.
    alone = short.join(fits.select("author").distinct(), "author", "left_anti").select(
        "author", F.concat_ws(" ", F.lit("person"), "family", F.concat(F.coalesce("letter", F.lit("")), F.lit("."))).alias("entity")
    )
    ambiguous = (
        short.join(fits.select("author").distinct(), "author", "left_semi").join(best, "author", "left_anti")
        .select("author", F.concat_ws(" ", F.lit("person"), "family", F.array_join("given", "."), F.lit("?")).alias("entity"))
    )
    return orgs.unionByName(resolved).unionByName(best).unionByName(alone).unionByName(ambiguous)


def _initials_score(given: pd.Series, first: pd.Series, middles: pd.Series) -> pd.Series:
    out = []
    for words, name, letters in zip(given, first, middles, strict=True):
        words = list(words)
        if len(words) < 2 or not letters:
            out.append(align(words[:1], [name]) if len(words) < 2 or not letters else 0.0)
        else:
            out.append(max(align(words, [name, m]) for m in letters))
    return pd.Series(out, dtype="float64")


def linked(books: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, author, entity)`` for each record whose author names somebody; a record delivered twice counts once."""
    records = books.select(key, F.col(column).alias("author")).where("author is not null").distinct()
    # Written once: pairs read it three times.
    return durable(records.join(entities(records), "author").select(key, "author", "entity"), "linked")


def pairs(links: DataFrame, key: str) -> DataFrame:
    """``(key_a, key_b)``: records of one entity whose spellings differ, the smaller key first.

    Spellings are paired first, so records that spell a name alike, however many, are never set against each other.
    """
    spelled = links.select("entity", "author").distinct()
    both = (
        spelled.select("entity", F.col("author").alias("author_a")).join(spelled.select("entity", F.col("author").alias("author_b")), "entity")
        .where("author_a < author_b").select("author_a", "author_b")
    )
    records = links.select(key, "author").distinct()
    out = (
        both.join(records.select(F.col("author").alias("author_a"), F.col(key).alias("a")), "author_a")
        .join(records.select(F.col("author").alias("author_b"), F.col(key).alias("b")), "author_b")
        .where("a != b")
    )
    return out.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
