"""Language detection, query lexicon, question intent and sentence guards, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vote words, diacritics, query lexicons.
FR = "le la les que quoi pourquoi comment quel quelle est des une doit".split()
ES = "el la los las que qué por cómo cuál cuáles es una debe para".split()
CJK = "[぀-ヿ一-鿿]"
LEX_FR = {
    "critère": "criteria", "critere": "criteria", "acceptation": "acceptance", "couverture": "coverage", "exigence": "requirement",
    "livraison": "release", "défaut": "defect", "defaut": "defect", "traçabilité": "traceability", "tracabilite": "traceability",
    "avant": "before", "promotion": "promotion", "embarquement": "boarding", "procédure": "procedure", "procedure": "procedure",
    "quel": "what", "quelle": "what", "est": "is", "pour": "for", "la": "", "le": "", "du": "", "des": "", "un": "", "une": "", "de": "", "d": "",
}
LEX_ES = {
    "criterio": "criteria", "aceptación": "acceptance", "aceptacion": "acceptance", "cobertura": "coverage", "requisito": "requirement",
    "versión": "release", "version": "release", "defecto": "defect", "trazabilidad": "traceability", "antes": "before",
    "promoción": "promotion", "promocion": "promotion", "embarque": "boarding", "procedimiento": "procedure", "cuál": "what", "cual": "what",
    "qué": "what", "que": "what", "es": "is", "para": "for", "la": "", "el": "", "de": "", "los": "", "las": "", "un": "", "una": "",
}
LEX_JA = {
    "要件": "requirement", "カバレッジ": "coverage", "受け入れ": "acceptance", "基準": "criteria", "リリース": "release",
    "欠陥": "defect", "トレーサビリティ": "traceability", "手順": "procedure", "搭乗": "boarding",
}
ENTITY_EDGE = "\"'.,;:!?()[]{}"


def let(value: Column, fn) -> Column:
    """``fn`` over a value computed once: inside a lambda an expression would run once per element."""
    return F.transform(F.array(value), fn)[0]


def lang_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ]+"), F.lit(0))


def detect_language(text: Column) -> Column:
    """ja on kana or CJK; else French against Spanish vote words with a diacritic bonus; else en."""
    w = lang_words(text)
    votes = lambda vocab: F.size(F.filter(w, lambda x: x.isin(*vocab)))
    es = votes(ES) + F.when(text.rlike("[ñ¿¡]"), 2).otherwise(0)
    fr = votes(FR) + F.when(text.rlike("[çœàèù]"), 1).otherwise(0)
    return F.when(text.rlike(CJK), "ja").when(F.size(w) == 0, "en").when((es > fr) & (es >= 1), "es").when((fr > es) & (fr >= 1), "fr").otherwise("en")


def _mapped(words: Column, lex: dict[str, str]) -> Column:
    m = F.create_map(*[x for k, v in lex.items() for x in (F.lit(k), F.lit(v))])
    return F.array_join(F.filter(F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w)), lambda w: w != ""), " ")


def translate_query(question: Column, code: Column) -> Column:
    """Word-by-word mapping to English; a word mapped to nothing is dropped, an empty result keeps the question."""
    words = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    ja = question
    for k, v in LEX_JA.items():
        ja = F.replace(ja, F.lit(k), F.lit(f" {v} "))
    out = F.when(code == "fr", _mapped(words, LEX_FR)).when(code == "es", _mapped(words, LEX_ES)).when(code == "ja", F.trim(ja)).otherwise(question)
    return F.coalesce(F.nullif(F.trim(out), F.lit("")), question)


# Question forms in order of precedence.
GREETING = r"^(hi|hey|hello|thanks|thank you|good (morning|afternoon|evening))\b"
COUNT = r"\b(how many|how much|number of|count of)\b"
COMPARISON = r"\b(vs|versus|compare|comparison|compared to|difference between|better than)\b"
LIST = r"\b(list|which|types of|kinds of|examples of|what are|name the)\b"


def question_intent(text: Column) -> Column:
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    short = (n <= 2) & ~text.contains("?")
    return (
        F.when((t == "") | t.rlike(GREETING) | short, "greeting").when(t.rlike(COUNT), "count").when(t.rlike(COMPARISON), "comparison")
        .when(t.rlike(LIST), "list").otherwise("definition")
    )


def _core(word: Column) -> Column:
    return F.btrim(word, F.lit(ENTITY_EDGE))


def rule_entities(text: Column) -> Column:
    """Capitalised names, acronyms and numbers, unique without case, in order."""
    cores = F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), _core)
    hits = F.filter(cores, lambda c: (c != "") & (c.rlike(r"\p{Nd}") | c.rlike(r"^\p{Lu}")))
    pairs = F.transform(hits, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x")))
    return let(F.struct(pairs.alias("p"), F.transform(hits, lambda h: F.lower(h)).alias("k")), lambda b: F.transform(
        F.filter(b["p"], lambda s: F.array_position(b["k"], s["k"]) == s["i"] + 1), lambda s: s["x"]))


def dedupe_sentences(sents: Column) -> Column:
    """Fold sentences with the same word sequence, first one kept, order kept."""
    key = lambda s: F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(s), r"\[\d+\]", " "), F.lit("[a-z0-9]+"), F.lit(0)), " ")
    rows = F.transform(sents, lambda s, i: F.struct(s.alias("s"), i.alias("i"), key(s).alias("k")))
    return let(rows, lambda r: let(F.struct(r.alias("r"), F.transform(r, lambda x: x["k"]).alias("k")), lambda b: F.transform(
        F.filter(b["r"], lambda x: (x["k"] != "") & (F.array_position(b["k"], x["k"]) == x["i"] + 1)), lambda x: x["s"])))


def entity_guard(sents: Column, evidence_tokens: Column) -> Column:
    """Sentences whose names, acronyms and numbers all occur in the evidence tokens."""

    def fine(s: Column, ev: Column) -> Column:
        ws = F.split(F.regexp_replace(F.regexp_replace(s, r"\[\d+\]", " "), r"^\s+|\s+$", ""), r"\s+")
        cores = F.transform(ws, lambda w, i: F.struct(_core(w).alias("c"), i.alias("i")))

        def ok(r: Column) -> Column:
            c = r["c"]
            entity = c.rlike(r"\p{Nd}") | ((F.length(c) >= 2) & c.rlike(r"^\p{Lu}.*\p{Lu}")) | ((r["i"] > 0) & c.rlike(r"^\p{Lu}"))
            norm = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
            return ~entity | (norm == "") | F.array_contains(ev, norm)

        return F.forall(cores, ok)

    return let(evidence_tokens, lambda ev: F.filter(sents, lambda s: fine(s, ev)))


# Joining words by intent.
CONNECTIVES = {
    "definition": ("In addition,", "Furthermore,", "Additionally,"),
    "list": ("Additionally,", "Also,", "Furthermore,", "Moreover,"),
    "comparison": ("In contrast,", "By comparison,", "Meanwhile,"),
    "count": ("In total,", "Additionally,", "Also,"),
    "greeting": ("",),
}


def compose_sentences(sents: Column, intent: Column) -> Column:
    """Unique sentences joined with the connectives of the intent, cycling."""
    conn = F.lit(None)
    for k, v in CONNECTIVES.items():
        arr = F.array(*[F.lit(x) for x in v])
        conn = F.when(intent == k, arr).otherwise(conn)
    conn = F.coalesce(conn, F.array(*[F.lit(x) for x in CONNECTIVES["definition"]]))
    joined = lambda uniq: F.transform(uniq, lambda s, i: F.when(i == 0, s).otherwise(F.ltrim(F.concat_ws(" ", F.get(conn, (i - 1) % F.size(conn)), s))))
    return let(dedupe_sentences(sents), lambda u: F.array_join(joined(u), " "))
