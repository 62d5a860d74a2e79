"""PII surrogates: detected entities get keyed replacements of their own type and format.

Patterns find e-mail addresses, IPv4 addresses, phone numbers, social security numbers,
payment cards, IBANs and personal names, titled or after a common given name. Every distinct
entity, in a normal form that joins its spellings, gets one surrogate from a keyed hash: digits
become digits and letters letters, names keep gender, script and capitals, card numbers their
checksum, and separators stay. An address's domain and a person's given and family name are
entities of their own, so what two people share stays shared. A name's gender is the one that
most of its titles say and no part of its identity. Surrogates are checked: where two entities of
a kind got the same one, or one equals an entity of the corpus, the later entity draws again, so
distinct entities stay distinct and equal ones equal everywhere. DataFrame functions only.

Texts are searched once; what was found is written beside them, and only texts that hold an
entity are joined to their replacements.

Defined cases: a null text stays null and has no entity, an empty text stays empty; rows that
share a doc_id are replaced each in its own text; repeated rows repeat their row; a table
without rows gives none; extra columns are kept by pseudonymise() and ignored by report().
Known limits: a name without a title is found only behind a given name of the list below.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import Folder, free_names

KEY = "surrogates-1"
#: From this draw on a surrogate is longer than its entity, by one more digit each time; a kind
#: that still clashes after the last draw has no free value left, which is an error.
LONGER, LAST_DRAW = 16, 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"
#: What may stand between a phone's digits; no number goes on into an address behind it.
_GAP = rf"[^\p{{L}}\p{{N}}\n]{{0,6}}(?!{_IP})"
_TITLE_M, _TITLE_F = r"Mr|Sir|Herrn?|Monsieur|Señor|Signor|Господин|Г-н", r"Mrs|Ms|Miss|Lady|Frau|Fräulein|Madame|Mademoiselle|Señora|Señorita|Signora|Госпожа|Г-жа"
_CASELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsArabic}\p{IsHebrew}]"
_NAME = rf"(?:\p{{Lu}}[\p{{L}}'’-]{{1,30}}|{_CASELESS}{{1,20}})"
#: Given names that tell a person without a title; none is a common word of the four languages.
_KNOWN_M = (
    "Adam Alan Alexander Andreas Andrew Anthony Antonio Benjamin Bernd Brian Carlos Charles Christian Christopher Daniel David Dieter Edward Eric Fernando "
    "François Friedrich George Günter Hans Heinrich Henry Jacques James Jason Javier Jean Jeffrey John Jonathan José Joseph Juan Jürgen Kevin Klaus Luis Manuel "
    "Matthew Michael Michel Miguel Nicholas Pablo Patrick Paul Peter Philippe Pierre Richard Robert Samuel Stefan Stephen Thomas Timothy Uwe Walter Werner William Wolfgang"
)
_KNOWN_F = (
    "Alice Amanda Amy Ana Andrea Angela Ann Anna Anne Barbara Carmen Carol Catherine Christine Claudia Cristina Cynthia Deborah Dorothy Elena Elizabeth Emily "
    "Emma Françoise Gabriele Hannah Heather Helen Ingrid Isabel Isabelle Jane Janet Jennifer Jessica Julia Karen Katherine Kathleen Laura Linda Lisa Lucía Margaret "
    "Maria María Marie Martha Mary Melissa Michelle Monika Nancy Nathalie Nicole Pamela Patricia Petra Rachel Rebecca Renate Ruth Sabine Sandra Sarah Sharon Sophie Susan Susanne Teresa Ursula Yolanda"
)
_KNOWN = "|".join([*_KNOWN_M.split(), *_KNOWN_F.split()])

#: Kind and pattern; the first that matches at a place wins.
PATTERNS = (
    ("email", r"[\p{L}\p{N}._%+-]{1,64}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){1,8}"),
    ("iban", rf"(?<![\p{{L}}\p{{N}}])[A-Z]{{2}}\d{{2}}(?:(?:(?: (?!{_IP}))?[A-Z0-9]{{4}}){{3,7}}(?:(?: (?!{_IP}))?[A-Z0-9]{{1,3}})?|(?: ?[A-Z0-9]{{4}}){{2}}(?: (?!{_IP}))?[A-Z0-9]{{3}})(?![\p{{L}}\p{{N}}])"),
    ("ip", _IP),
    # Country 1 has ten digits more; elsewhere numbers differ in length and go as far as their groups.
    (
        "phone",
        rf"(?<![\p{{L}}\p{{N}}])(?:\+1{_GAP}\(?\d{{3}}\)?{_GAP}\d{{3}}{_GAP}\d{{4}}|\+\d{{1,3}}[^\p{{L}}\p{{N}}\n]{{0,6}}\(?\d{{2,4}}\)?(?:{_GAP}\d{{2,4}}){{1,4}}"
        r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    ),
    ("ssn", r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("card", rf"(?<![\p{{L}}\p{{N}}])\d(?:(?:[ -](?!{_IP}))?\d){{12,18}}(?![\p{{L}}\p{{N}}])"),
    ("name", rf"(?<!\p{{L}})(?:(?:{_TITLE_M}|{_TITLE_F}|Dr|Prof|Mx)\.? {_NAME}(?: {_NAME})?|(?:{_KNOWN}) \p{{Lu}}[\p{{L}}'’-]{{1,30}})"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)

#: Syllables of made-up names by script, and how a given name ends by gender.
SYLLABLES = {
    "Latn": "bar len mor tis van kel dor rin sal wen hol mar tor nel bri gan",
    "Cyrl": "бар лен мор тис ван кел дор рин сал вен хол мар тор нел бри ган",
    "Grek": "βαρ λεν μορ τισ βαν κελ δορ ριν σαλ ναν χολ μαρ τορ νελ βρι γαν",
    "Hani": "安 林 文 明 德 永 国 成 志 海 春 东 云 江 山 石",
    "Kana": "あ い か き さ た な に は ま み や ら り わ こ",
    "Hang": "가 나 다 라 마 바 사 아 자 차 하 민 준 서 윤 호",
    "Arab": "با لن مو تس فا كل دو رن سا ون هو مر تو نل بر غا",
    "Hebr": "בר לן מור תיס ון קל דור רין סל ון חול מר טור נל ברי גן",
}
ENDINGS = {
    ("m", "Latn"): "o us ik an", ("f", "Latn"): "a ia ine elle", ("x", "Latn"): "el en is y",
    ("m", "Cyrl"): "ан ик ер ел", ("f", "Cyrl"): "а ия ина елла", ("x", "Cyrl"): "и ю е о",
    ("m", "Grek"): "ος ης ας ων", ("f", "Grek"): "α η ια ινη", ("x", "Grek"): "ι υ ε ω",
}
SCRIPTS = (("Cyrl", r"\p{IsCyrillic}"), ("Grek", r"\p{IsGreek}"), ("Kana", r"[\p{IsHiragana}\p{IsKatakana}]"), ("Hani", r"\p{IsHan}"), ("Hang", r"\p{IsHangul}"), ("Arab", r"\p{IsArabic}"), ("Hebr", r"\p{IsHebrew}"))
ALPHABETS = (("0123456789", r"\p{N}"), ("abcdefghijklmnopqrstuvwxyz", r"\p{Ll}"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{Lu}"))
#: Letters beyond Latin that stay in their script.
OTHERS = (("абвгдежзиклмнопрстуфхцчшэюя", r"[\p{IsCyrillic}&&\p{Ll}]"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"[\p{IsCyrillic}&&\p{Lu}]"), ("αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Ll}]"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"[\p{IsGreek}&&\p{Lu}]"))

_UNIT = "array<struct<lead:string,kind:string,norm:string,raw:string,gender:string>>"


def _kind(hit: Column) -> Column:
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(hit.rlike(r"^\p{L}{2}\d"), "iban")
        .when(hit.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(hit.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .when(hit.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(hit.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def _script(name: Column) -> Column:
    return reduce(lambda rest, s: F.when(name.rlike(s[1]), s[0]).otherwise(rest), reversed(SCRIPTS), F.lit("Latn"))


def _units(hit: Column) -> Column:
    """A hit as the pieces to replace, each behind literal text: one, or two of an address or a name."""
    kind = _kind(hit)
    piece = lambda lead, kind, norm, raw, gender=F.lit(None): F.struct(lead.alias("lead"), kind.alias("kind"), norm.alias("norm"), raw.alias("raw"), gender.cast("string").alias("gender"))
    norm = F.when(kind == "ip", hit).otherwise(F.upper(F.regexp_replace(hit, r"[^\p{L}\p{N}]", "")))
    one = F.array(piece(F.lit(""), kind, norm, hit)).cast(_UNIT)
    local, domain = F.substring_index(hit, "@", 1), F.substring_index(hit, "@", -1)
    address = F.array(piece(F.lit(""), F.lit("local"), F.lower(hit), local), piece(F.lit("@"), F.lit("domain"), F.lower(domain), domain)).cast(_UNIT)
    known = hit.rlike(rf"^(?:{_KNOWN}) ")
    title = F.when(known, "").otherwise(F.regexp_extract(hit, r"^([^ ]+ )", 1))
    rest = F.split(F.substring(hit, F.length(title) + 1, F.length(hit)), " ")
    man, woman = rf"^(?:(?:{_TITLE_M})\b|(?:{'|'.join(_KNOWN_M.split())}) )", rf"^(?:(?:{_TITLE_F})\b|(?:{'|'.join(_KNOWN_F.split())}) )"
    gender = F.when(hit.rlike(man), "m").when(hit.rlike(woman), "f")
    name = lambda lead, kind, raw, *g: piece(lead, F.concat(F.lit(f"{kind}_"), _script(raw)), F.lower(raw), raw, *g)
    both = F.array(name(title, "given", rest[0], gender), name(F.lit(" "), "family", F.get(rest, 1))).cast(_UNIT)
    last = F.array(name(title, "family", rest[0])).cast(_UNIT)
    return F.when(kind == "email", address).when(kind != "name", one).when(F.size(rest) > 1, both).otherwise(last)


def detected(docs: DataFrame, column: str) -> DataFrame:
    """docs with a column of hits, in order; the one search of all texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Most texts without a digit or @ need the search for names only.
    some = text.rlike("[0-9@]") | text.rlike(PATTERNS[-1][1])
    return docs.withColumn(column, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))


def occurrences(docs: DataFrame, column: str) -> DataFrame:
    """(doc_id, version, at, unit, lead, kind, norm, raw, gender): every piece to replace, in order."""
    hits = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(column).alias("at", "hit"))
    units = hits.select("doc_id", "version", "at", F.posexplode(_units(F.col("hit"))).alias("unit", "u"))
    return units.select("doc_id", "version", "at", "unit", "u.*").dropDuplicates(["doc_id", "version", "at", "unit"])


def _pick(digest: Column, at: Column, alphabet: str) -> Column:
    """A character of an alphabet by the keyed digest's byte at a place."""
    # Each place reads four hex digits, wrapping around behind the 64th.
    number = F.conv(F.substring(F.concat(digest, digest), ((at * 4) % 61 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


def _alike(text: Column, digest: Column, fixed: int = 0) -> Column:
    """A text of the same shape: digits for digits, letters for letters of the script and case."""

    def one(c: Column, i: Column) -> Column:
        made = c
        for alphabet, pattern in (*reversed(ALPHABETS), *OTHERS):
            made = F.when(c.rlike(pattern), _pick(digest, i, alphabet)).otherwise(made)
        return F.when(i < fixed, c).otherwise(made) if fixed else made

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number behind which a check digit is to stand."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _checked(norm: Column, made: Column) -> Column:
    """A card number whose check digit is right if the original's was."""
    body, own = F.substring(norm, F.lit(1), F.length(norm) - 1), F.substring(norm, -1, 1).cast("int")
    right = (_luhn_sum(body) + own) % 10 == 0
    new = F.substring(made, F.lit(1), F.length(made) - 1)
    return F.when(right, F.concat(new, ((10 - _luhn_sum(new) % 10) % 10).cast("string"))).otherwise(made)


def _said(digest: Column, syllables: str, n: Column, first: int = 0) -> Column:
    """n syllables that the digest picks."""
    pool = F.array(*[F.lit(x) for x in syllables.split()])
    pick = lambda i: F.conv(F.substring(F.concat(digest, digest), ((i * 4 + first) % 61 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % len(syllables.split()) + 1
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(pool, pick(i))), "")


def _surrogate(kind: Column, norm: Column, gender: Column, draw: Column) -> Column:
    digest = F.sha2(F.concat_ws("\x1f", F.lit(KEY), kind, norm, draw.cast("string")), 256)
    number = lambda at, width: F.conv(F.substring(digest, at, width), 16, 10).cast("int")
    more = lambda n, alphabet: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: _pick(digest, i + 7, alphabet)), "")
    letters = F.when(draw > 0, more(draw, ALPHABETS[1][0])).otherwise("")
    made = F.when(kind == "local", F.concat(_alike(F.substring_index(norm, "@", 1), digest), letters))
    made = made.when(kind == "domain", F.concat(F.lit("m"), F.substring(digest, F.lit(1), draw * 4 + 10), F.lit(".example.net")))
    made = made.when(kind == "ip", F.concat_ws(".", (number(1, 4) % 223 + 1).cast("string"), *[(number(1 + 4 * i, 4) % 256).cast("string") for i in (1, 2, 3)]))
    for script, syllables in SYLLABLES.items():
        cased = lambda c, script=script: F.initcap(c) if script in ("Latn", "Cyrl", "Grek") else c
        short = 1 if script in ("Hani", "Kana", "Hang") else 2
        ending = F.lit("")
        for (g, s), said in ENDINGS.items():
            if s == script:
                ending = F.when(F.coalesce(gender, F.lit("x")) == g, _said(digest, said, F.lit(1), 40)).otherwise(ending)
        made = made.when(kind == f"given_{script}", cased(F.concat(_said(digest, syllables, draw + short), ending)))
        made = made.when(kind == f"family_{script}", cased(_said(digest, syllables, draw + short + 1)))
    # A phone number keeps its first digit, which may be its country's, an account its country.
    plain = F.when(kind == "iban", _alike(norm, digest, 2)).when(kind == "phone", _alike(norm, digest, 1)).when(kind == "card", _checked(norm, _alike(norm, digest))).otherwise(_alike(norm, digest))
    return made.otherwise(F.concat(plain, F.when(draw >= LONGER, more(draw - LONGER + 1, ALPHABETS[0][0])).otherwise("")))


def surrogates(found: DataFrame, folder: Folder) -> DataFrame:
    """(kind, norm, surrogate): one row per distinct entity, all surrogates of a kind distinct."""
    men, women = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    todo = found.groupBy("kind", "norm").agg(F.when(men > women, "m").when(women > men, "f").otherwise("x").alias("gender")).withColumn("draw", F.lit(0))
    made = _surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("draw"))
    table = folder.keep("draw0", todo.withColumn("surrogate", made))
    first = Window.partitionBy("kind", F.lower("surrogate")).orderBy("draw", "norm")
    for turn in range(1, LAST_DRAW + 2):
        real = table.select(F.col("kind").alias("k"), F.lower("norm").alias("n"), F.lit(True).alias("real")).distinct()
        checked = table.withColumn("place", F.row_number().over(first))
        checked = checked.join(real, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.col("n")), "left")
        clash = (F.col("place") > 1) | F.col("real").isNotNull()
        checked = folder.keep(f"checked{turn}", checked.select("kind", "norm", "gender", "draw", "surrogate", clash.alias("clash")))
        if checked.where("clash").isEmpty():
            return table.select("kind", "norm", "surrogate")
        if turn > LAST_DRAW:
            raise ValueError(f"no free surrogates are left for: {[r[0] for r in checked.where('clash').select('kind').distinct().limit(20).collect()]}")
        again = checked.withColumn("draw", F.col("draw") + F.col("clash").cast("int"))
        table = folder.keep(f"draw{turn}", again.select("kind", "norm", "gender", "draw", F.when(F.col("clash"), made).otherwise(F.col("surrogate")).alias("surrogate")))


def _formatted(raw: Column, kind: Column, made: Column) -> Column:
    """A surrogate in the format of an occurrence: its separators, its capitals."""
    slots = F.aggregate(
        F.split(raw, ""),
        F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda s, c: F.when(
            c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(s.text, F.substring(made, s.next, F.lit(1))).alias("text"), (s.next + 1).alias("next"))
        ).otherwise(F.struct(F.concat(s.text, c).alias("text"), s.next.alias("next"))),
        lambda s: F.concat(s.text, F.substring(made, s.next, F.length(made))),
    )
    loud = F.when(raw == F.upper(raw), F.upper(made)).otherwise(made)
    return F.when(kind.isin("local", "domain") | kind.rlike("^(given|family)_"), loud).when(kind == "ip", made).otherwise(slots)


def replacements(found: DataFrame, folder: Folder) -> DataFrame:
    """(doc_id, version, news): what stands for each hit of a document, in order."""
    said = found.join(surrogates(found, folder), ["kind", "norm"])
    said = said.withColumn("new", F.concat("lead", _formatted(F.col("raw"), F.col("kind"), F.col("surrogate"))))
    hits = said.groupBy("doc_id", "version", "at").agg(F.array_join(F.sort_array(F.collect_list(F.struct("unit", "new")))["new"], "").alias("new"))
    return hits.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list(F.struct("at", "new")))["new"].alias("news"))


def _rebuilt(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str]:
    """keep + hits, text replaced, and the name of the column of hits."""
    folder = Folder(docs.sparkSession, "pii")
    hits, id_, version, news = free_names(docs.columns, "hits", "doc", "version", "news")
    found = folder.keep("detected", detected(docs.select(*keep), hits))
    some = found.where(F.size(hits) > 0)
    made = replacements(folder.keep("occurrences", occurrences(some, hits)), folder).toDF(id_, version, news)
    made = folder.keep("news", made)
    folder.only("detected", "news")
    rows = some.join(made, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(version)))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), F.col(news), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    kept = [text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in keep]
    return rows.select(*kept, hits).unionByName(found.where(F.size(hits) == 0).select(*keep, hits)), hits


def pseudonymise(docs: DataFrame) -> DataFrame:
    """docs with every entity replaced; n_chars, where there, follows the new text."""
    made, hits = _rebuilt(docs, docs.columns)
    return made.select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_entities, kinds (in order of place) and the new text."""
    made, hits = _rebuilt(docs.select("doc_id", "text"), ["doc_id", "text"])
    return made.select("doc_id", F.size(hits).cast("long").alias("n_entities"), F.array_join(F.transform(hits, _kind), ",").alias("kinds"), "text")
