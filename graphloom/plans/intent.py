"""What a question asks for: rules as data, applied to a batch of questions at once.

The rules are ordered and the first pattern contained in the question decides. ``word_boundary`` asks for whole words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Question types in order, the phrases that show them and the metaedges that answer them.
RULES = (
    ("anatomy_expression", ("expressed in", "expression in", "genes in", "expressed by", "genes are expressed", "what genes are expressed"), ("AeG",)),
    ("gene_expression_location", ("where is", "expressed in", "found in", "located in", "where does"), ("GeA",)),
    ("biological_participation", ("participates in", "involved in", "role in", "part of", "participate"), ("GpBP", "GpMF", "GpCC")),
    ("gene_interaction", ("interacts", "interaction", "binds", "binding", "interact with", "which genes interact"), ("GiG",)),
    ("disease_gene_regulation", ("regulates", "upregulates", "downregulates", "associated", "associates"), ("DuG", "DdG", "DaG")),
    ("disease_treatment", ("treats", "treatment", "therapy", "therapeutic", "treat"), ("CtD",)),
    ("compound_gene_regulation", ("upregulates", "downregulates", "binds to", "regulates"), ("CuG", "CdG", "CbG")),
    ("anatomy_disease", ("diseases in", "affects", "localized to", "disease in"), ("DlA",)),
    ("disease_tissue_effect", ("how does", "affect", "affects", "effect on", "effects on", "tissue", "tissues"), ("DlA", "DuG", "DdG", "AeG", "AuG", "AdG", "GpBP")),
    ("disease_symptom", ("symptoms", "presents", "signs", "manifestation", "symptom"), ("DpS",)),
    ("disease_similarity", ("similar", "resembles", "alike", "related", "similar to"), ("DrD",)),
    ("compound_side_effect", ("side effect", "adverse", "reaction", "causes", "side effects"), ("CcSE",)),
    ("gene_pathway", ("pathway", "signaling", "metabolic", "cascade", "pathways"), ("GpPW",)),
    ("gene_regulation", ("regulates", "controls", "regulation", "regulate"), ("Gr>G",)),
    ("gene_covariation", ("covary", "covaries", "co-vary", "co-varies", "coexpression", "co-expression", "coexpressed", "correlated", "correlation", "هم‌واریانس", "همواریانس", "هم‌بروز", "همبروز", "هم‌تغییر", "همتغییر"), ("GcG",)),
)

#: Groups of (phrases, intent, allowed metaedges, end kinds, hops). In a group the first rule that holds
#: counts, and a later group overrides an earlier one.
SCHEMA_GROUPS = (
    (
        (("co-expression", "coexpression", "covary", "covaries", "هم‌واریانس", "هم‌بروز", "هم‌تغییر"), "G-G_covary", ("GcG",), ("Gene",), 1),
        (("interaction", "interacts", "ppi", "تعامل"), "G-G_interact", ("GiG",), ("Gene",), 1),
        (("regulates", "regulation", "تنظیم"), "G-G_regulates", ("Gr>G",), ("Gene",), 1),
        (("treats", "treatment", "therapy", "therapeutic", "درمان", "پالیتیو"), "D→(C|PC)", ("CtD", "CpD", "PCiC", "CbG"), ("Compound", "Pharmacologic Class"), 3),
        (("drug", "compound", "pharmacologic class", "mechanism", "target"), "G→(C|PC)", ("GiG", "Gr>G", "CbG", "PCiC"), ("Compound", "Pharmacologic Class"), 4),
        (("disease", "associated", "association", "بیماری"), "G→D", ("DaG",), ("Disease",), 2),
    ),
    ((("symptom", "علائم", "signs"), "D→S", ("DpS",), ("Symptom",), 1),),
    ((("anatomy", "tissue", "بافت", "anatomical", "localized"), "D→A", ("DlA",), ("Anatomy",), 1),),
    (
        (("side effect", "adverse", "عوارض"), "C→SE", ("CcSE",), ("Side Effect",), 1),
        (("mechanism", "target", "binds", "regulates"), "C→(G|BP|PW)", ("CbG", "PCiC", "GiG", "Gr>G", "GpPW", "GpBP"), ("Gene", "Biological Process", "Pathway"), 2),
    ),
    ((("expressed in", "expression", "بیان"), "A→G_expression", ("AeG",), ("Gene",), 1),),
    ((("upregulates", "downregulates", "regulates"), "A→G_regulation", ("AuG", "AdG"), ("Gene",), 1),),
    ((("pathway", "biological process", "molecular function", "go:"), "G↔(PW|BP|MF)", ("GpPW", "GpBP", "GpMF"), ("Gene", "Pathway", "Biological Process", "Molecular Function"), 1),),
)
#: Intents that ask for a treatment edge at a disease, what is asked for when an intent finds nothing, and
#: the phrases that allow similarity edges, which are denied otherwise.
REQUIRED = {"D→(C|PC)": (("CtD", "CpD"), "Disease"), "D→(C|PC)_palliative": (("CtD", "CpD"), "Disease")}
FALLBACK = {
    "G-G_covary": ("G-G_interact", ("GiG",), ("Gene",), 1),
    "D→(C|PC)": ("D→(C|PC)_palliative", ("CpD", "PCiC"), ("Compound", "Pharmacologic Class"), 3),
    "C→(G|BP|PW)": ("C→PC→C", ("PCiC",), ("Gene", "Biological Process", "Pathway", "Compound", "Pharmacologic Class"), 3),
    "G→(C|PC)": ("G→G→(C|PC)", ("GiG", "Gr>G", "CbG", "PCiC"), ("Compound", "Pharmacologic Class"), 4),
}
SIMILARITY_WORDS, SIMILARITY_EDGES = ("resembles", "similar", "similarity", "alike"), ("DrD", "CrC")
#: Metaedges of a path that match what a question asks.
MATCHES = (
    ("GcG", ("covary", "co-expression", "coexpression", "هم‌واریانس")),
    ("GiG", ("interaction", "interacts", "ppi", "تعامل")),
    ("Gr>G", ("regulates", "regulation", "تنظیم")),
    ("CtD", ("treats", "درمان")),
    ("CbG", ("binds", "target", "mechanism")),
)
#: Words that show the kinds a question is about.
KIND_WORDS = {
    "Gene": ("gene", "genes", "protein", "proteins", "dna", "rna", "mrna", "genetic", "molecular", "tp53", "brca1", "apoe", "cftr", "mmp9", "bid", "kcnq2", "hmgb3"),
    "Anatomy": ("anatomy", "organ", "tissue", "heart", "brain", "liver", "lung", "kidney", "stomach", "breast"),
    "Disease": ("disease", "disorder", "condition", "syndrome", "cancer", "tumor", "alzheimer", "diabetes", "cystic fibrosis", "breast cancer", "lung cancer", "heart disease"),
    "Compound": ("compound", "drug", "medication", "medicine", "chemical", "molecule", "aspirin", "insulin", "caffeine", "vitamin c", "metformin", "ibuprofen", "paracetamol"),
    "Biological Process": ("process", "biological", "cellular", "metabolic", "apoptosis", "inflammation", "cell death", "dna repair", "cell cycle"),
    "Pathway": ("pathway", "signaling", "metabolic", "cascade", "wnt", "notch", "apoptosis pathway"),
    "Symptom": ("symptom", "sign", "manifestation", "presentation", "pain", "fever", "cough", "fatigue"),
    "Side Effect": ("side effect", "adverse", "reaction", "toxicity", "nausea", "headache", "dizziness"),
    "Molecular Function": ("function", "molecular", "catalytic", "binding", "enzyme", "receptor", "transporter"),
    "Cellular Component": ("component", "cellular", "organelle", "structure", "nucleus", "mitochondria", "cell membrane"),
    "Pharmacologic Class": ("class", "pharmacologic", "therapeutic", "antibiotic", "antiviral", "nsaid"),
}
BACKWARD_WORDS = ("where", "location", "found in", "expressed in", "where is", "where does")
#: Questions of several steps: two groups of words of which each must occur, or metaedges of the rule.
COMPLEX = (
    ("complex_expression", ("upregulate", "downregulate", "regulate"), ("expressed", "expression")),
    ("complex_disease", ("interact", "interaction"), ("disease", "associated")),
    ("complex_treatment", ("treat", "treatment", "therapy"), ("compound", "drug", "medicine")),
    ("complex_function", ("function", "process", "pathway"), ("gene", "protein")),
)
COMPLEX_EDGES = (
    ("complex_expression", ("AeG",), ("CuG", "CdG")),
    ("complex_disease", ("DaG",), ("GiG", "GpBP")),
    ("complex_treatment", ("CtD",), ("DaG", "CuG")),
    ("complex_function", ("GpBP", "GpPW"), ("GpBP", "GpPW")),
)
SIMPLE_TYPES = ("anatomy_expression", "compound_gene_regulation", "disease_gene_regulation")
#: Metaedge patterns of the question types of several steps.
PATTERNS = {
    "anatomy_expression": (("AeG",), ("AuG",), ("AdG",)),
    "compound_gene_regulation": (("CuG",), ("CdG",), ("CbG",)),
    "disease_gene_regulation": (("DuG",), ("DdG",), ("DaG",)),
    "complex_expression": (("AeG", "CuG"), ("AeG", "CdG"), ("GeA", "GuC"), ("GeA", "GdC"), ("CdG", "GeA"), ("CuG", "GeA")),
    "complex_disease": (("DaG", "GiG"), ("DuG", "GpBP"), ("DlA", "AeG"), ("GaD", "GpBP")),
    "complex_treatment": (("CtD", "DaG"), ("CuG", "GaD"), ("CdG", "GaD"), ("DtC", "CuG"), ("GuC", "CtD")),
    "complex_function": (("GpBP", "BPpG"), ("GpPW", "PWpG"), ("GiG", "GpBP"), ("Gr>G", "GpMF")),
}
#: Kinds of answers and the words that ask for them.
ANSWER_TYPES = (
    ("DESCRIPTION", ("what", "which", "how")),
    ("TIME", ("when", "time", "date")),
    ("LOCATION", ("where", "location")),
    ("CAUSE", ("why", "cause", "reason")),
    ("EFFECT", ("effect", "result", "outcome")),
)
CANCER_WORDS = ("cancer", "tumor", "malignancy", "oncology", "carcinoma", "sarcoma", "leukemia", "lymphoma")


def _holds(q: Column, phrase: str, word_boundary: bool) -> Column:
    return q.rlike(f"(?<![a-z0-9]){phrase}(?![a-z0-9])") if word_boundary else q.contains(phrase)


def question_type(question: Column, word_boundary: bool = False) -> Column:
    """Type of a question by the first rule that holds; ``general`` if none does."""
    q = F.lower(question)
    col = None
    for name, phrases, _ in RULES:
        any_ = F.lit(False)
        for p in phrases:
            any_ = any_ | _holds(q, p, word_boundary)
        col = F.when(any_, name) if col is None else col.when(any_, name)
    return col.otherwise("general")


def _any(q: Column, phrases: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for p in phrases:
        held = held | q.contains(p)
    return held


def schema_intent(question: Column) -> Column:
    """Intent by the last group in which a rule holds, there the first; ``general`` if none does."""
    q, col = F.lower(question), F.lit("general")
    for group in SCHEMA_GROUPS:
        for phrases, intent, *_ in reversed(group):
            col = F.when(_any(q, phrases), intent).otherwise(col)
    # Within a group rules were added from the last to the first, so the first one that holds is outermost.
    return col


def schema_plan(question: str) -> dict:
    """What paths answer one question: intent, allowed and denied metaedges, end kinds, hops, required edges."""
    q, rule = question.lower(), ("general", (), (), 2)
    for group in SCHEMA_GROUPS:
        rule = next((r[1:] for r in group if any(p in q for p in r[0])), rule)
    deny = () if any(w in q for w in SIMILARITY_WORDS) else SIMILARITY_EDGES
    return {"intent": rule[0], "allow": list(rule[1]), "deny": list(deny), "end_kinds": list(rule[2]), "hops": rule[3], "required": REQUIRED.get(rule[0]), "match": [m for m, ws in MATCHES if any(w in q for w in ws)]}


def fallback_plan(plan: dict) -> dict | None:
    """What is asked for when a plan finds nothing."""
    rule = FALLBACK.get(plan["intent"])
    return rule and plan | {"intent": rule[0], "allow": list(rule[1]), "end_kinds": list(rule[2]), "hops": rule[3], "required": REQUIRED.get(rule[0])}


def question_kinds(question: Column) -> Column:
    """Array of the kinds that a question names, in the order of the table."""
    q = F.lower(question)
    return F.array_compact(F.array(*[F.when(_any(q, ws), F.lit(k)) for k, ws in KIND_WORDS.items()]))


def direction(question: Column) -> Column:
    """reverse for questions about places, else forward."""
    return F.when(_any(F.lower(question), BACKWARD_WORDS), "reverse").otherwise("forward")


def answer_types(question: Column) -> Column:
    """Array of the kinds of answers that a question asks for."""
    q = F.lower(question)
    return F.array_compact(F.array(*[F.when(_any(q, ws), F.lit(t)) for t, ws in ANSWER_TYPES]))


def complex_type(question: Column) -> Column:
    """Type of a question of several steps: by two groups of words, by the metaedges of its rule, or the rule itself."""
    q, kind = F.lower(question), question_type(question)
    edges = {n: set(ms) for n, _, ms in RULES}
    col = None
    for name, a, b in COMPLEX:
        held = _any(q, a) & _any(q, b)
        col = F.when(held, name) if col is None else col.when(held, name)
    for name, one, other in COMPLEX_EDGES:
        types = [t for t, ms in edges.items() if ms & set(one) and ms & set(other)]
        col = col.when(kind.isin(types), name)
    return col.when(kind.isin(*SIMPLE_TYPES), kind).otherwise("general")


def about_cancer(text: Column) -> Column:
    """Whether a text names cancers."""
    return _any(F.lower(text), CANCER_WORDS)


def rule_metaedges(spark: SparkSession) -> DataFrame:
    """(question_type, metaedge) of all rules."""
    return spark.createDataFrame([(n, m) for n, _, ms in RULES for m in ms], "question_type string, metaedge string")
