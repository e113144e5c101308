"""Word lists, labels and formats that results depend on.

They describe the corpus language (Norwegian legal text) and are plain data;
every function that uses them takes another list as a parameter.
"""

# Document type -> words that name it, in order of precedence.
LAW_TYPES = [
    ("Lov", ["lov", "act"]),
    ("Forskrift", ["forskrift", "regulation"]),
    ("Vedtak", ["vedtak", "decision"]),
    ("Cirkulær", ["cirkulær", "circular"]),
    ("Rundskriv", ["rundskriv", "circular letter"]),
    ("Instruks", ["instruks", "instruction"]),
    ("Reglement", ["reglement", "regulations"]),
    ("Vedlegg", ["vedlegg", "annex", "appendix"]),
]

# The same for the text of a query.
QUERY_LAW_TYPES = [
    ("Forskrift", ["forskrift"]),
    ("Lov", ["lov"]),
    ("Vedtak", ["vedtak", "decision"]),
    ("Cirkulær", ["cirkulær", "circular"]),
    ("Rundskriv", ["rundskriv", "circular letter"]),
    ("Instruks", ["instruks", "instruction"]),
    ("Reglement", ["reglement", "regulations"]),
]

# Order in which a search without a type filter tries the types.
TYPE_PRIORITY = ["Lov", "Forskrift", "Vedtak", "Instruks", "Reglement", "Vedlegg"]

# Ministry name, abbreviation, other names in documents, other names in queries.
MINISTRIES = [
    ("Arbeids- og sosialdepartementet", "asd", ["arbeidsdepartementet"], ["arbeidsdepartementet"]),
    ("Barne- og familiedepartementet", "bfd", ["barnefamiliedepartementet"], ["barnefamiliedepartementet"]),
    ("Digitaliserings- og forvaltningsdepartementet", "dfd", [], []),
    ("Finansdepartementet", "fd", [], []),
    ("Forsvarsdepartementet", "fd", [], []),
    ("Helse- og omsorgsdepartementet", "hod", [], []),
    ("Justis- og beredskapsdepartementet", "jbd", [], ["justisdepartementet"]),
    ("Klima- og miljødepartementet", "kmd", [], []),
    ("Kommunal- og distriktsdepartementet", "kdd", [], []),
    ("Kultur- og likestillingsdepartementet", "kld", [], []),
    ("Nærings- og fiskeridepartementet", "nfd", [], []),
    ("Olje- og energidepartementet", "oed", [], []),
    ("Samferdselsdepartementet", "sfd", [], []),
    ("Utdannings- og forskningsdepartementet", "ufd", [], []),
    ("Utenriksdepartementet", "ud", [], []),
]

# Tags that hold a title or a date, first hit wins.
TITLE_TAGS = ["tittel", "tittel1", "title", "overskrift"]
DATE_TAGS = ["dato", "ikrafttredelse", "kunngjort", "published"]

# Labels of the metadata block at the head of a document.
METADATA_LABELS = [
    "Datokode",
    "DokumentID",
    "Departement",
    "Publisert",
    "I kraft fra",
    "Endrer",
    "Kunngjort",
    "Journalnummer",
    "Korttittel",
    "Tittel",
    "Annet om dokumentet",
    "RefID",
]

# Words in a title that mark a document which changes another one.
AMENDMENT_WORDS = [
    "endring",
    "ikraftsetting",
    "ikraftsetjing",
    "ikrafttredelse",
    "delegering",
    "overføring",
    "opphevelse",
]

# Named base laws: name in the query -> patterns of the official title.
BASE_LAW_TITLES = {
    "ekteskapsloven": [
        r"^lov\s+4\.?\s+juli\s+1991\s+nr\.?\s+47\s+om\s+ekteskap",
        r"lov\s+1991\s+nr\.?\s+47\s+om\s+ekteskap",
    ],
    "ekteskapslova": [
        r"^lov\s+4\.?\s+juli\s+1991\s+nr\.?\s+47\s+om\s+ekteskap",
        r"lov\s+1991\s+nr\.?\s+47\s+om\s+ekteskap",
    ],
}
BASE_LAW_STEM = "ekteskap"

# Term -> related terms appended to a query.
TERM_EXPANSIONS = {
    "ekteskap": ["ekteskapsloven", "ekteskapsloven", "ekteskapsrett", "ekteskapsbrudd"],
    "skjevdeling": ["ekteskapsloven", "ekteskapsbrudd", "ekteskapsløsning", "ekteskapsrett"],
    "ekteskapsløsning": ["ekteskapsloven", "skjevdeling", "ekteskapsbrudd"],
    "ekteskapsbrudd": ["ekteskapsloven", "skjevdeling", "ekteskapsløsning"],
    "barnebidrag": ["barnebidragsloven", "underholdsbidrag", "bidrag"],
    "arverett": ["arveloven", "arv", "arving"],
    "arbeidsrett": ["arbeidsmiljøloven", "arbeidsmiljø", "arbeidsforhold"],
    "personvern": ["personvernloven", "gdpr", "personopplysninger"],
    "kjøpsloven": ["kjøpsloven", "kjøp", "kjøpsrett"],
    "forbrukerkjøp": ["forbrukerkjøpsloven", "forbrukerrett", "kjøpsloven"],
    "leie": ["husleieloven", "leieforhold", "leierett"],
    "husleie": ["husleieloven", "leie", "leieforhold"],
    "ansettelse": ["arbeidsmiljøloven", "ansettelsesforhold", "arbeidsforhold"],
    "oppsigelse": ["arbeidsmiljøloven", "oppsigelsesrett", "oppsigelse"],
    "sykefravær": ["arbeidsmiljøloven", "sykepenger", "sykefravær"],
    "mobbing": ["arbeidsmiljøloven", "diskriminering", "trakassering"],
    "diskriminering": ["diskrimineringsloven", "likestillingsloven", "diskriminering"],
    "likestilling": ["likestillingsloven", "diskrimineringsloven", "likestilling"],
}

# Common name of a law -> parts of its official title.
OFFICIAL_TITLES = {
    "ekteskapsloven": [
        "lov 4. juli 1991 nr. 47 om ekteskap",
        "lov 4 juli 1991 nr 47 om ekteskap",
        "1991 nr 47",
        "nr 47",
        "nr. 47",
        "lov 1991 47",
    ],
    "ekteskapslova": [
        "lov 4. juli 1991 nr. 47 om ekteskap",
        "lov 4 juli 1991 nr 47 om ekteskap",
        "1991 nr 47",
        "nr 47",
        "nr. 47",
        "lov 1991 47",
    ],
    "arveloven": ["lov om arv", "arvelov"],
    "arbeidsmiljøloven": ["lov om arbeidsmiljø", "arbeidsmiljølov"],
    "barnebidragsloven": ["lov om barnebidrag", "barnebidragslov"],
    "personvernloven": ["lov om personvern", "personvernlov"],
    "kjøpsloven": ["lov om kjøp", "kjøpslov"],
    "forbrukerkjøpsloven": ["lov om forbrukerkjøp", "forbrukerkjøpslov"],
    "husleieloven": ["lov om husleie", "husleielov"],
    "diskrimineringsloven": ["lov om diskriminering", "diskrimineringslov"],
    "likestillingsloven": ["lov om likestilling", "likestillingslov"],
}

# Link patterns: a link is a document when no first pattern and some second one fits.
NON_DOCUMENT_LINKS = [
    r"/register/",
    r"/sok/",
    r"/search",
    r"/resultat",
    r"/oversikt",
    r"/liste",
    r"/index",
    r"\?.*kunngjortDato",
    r"\?.*q=",
]
DOCUMENT_LINKS = [
    r"/dokument/",
    r"/lov/",
    r"/forskrift/",
    r"/avgjorelse/",
    r"/rundskriv/",
    r"/vedtak/",
    r"/lovsamling/",
    r"/historikk/",
    r"/lokaleForskrifter/",
    r"/lovtidend/",
    r"/eosavtalen/",
    r"/traktater/",
    r"/trygderetten/",
    r"/tariffavtaler/",
    r"/husleietvistutvalget/",
    r"/sph2025/",
    r"/dom/",
    r"/rettsavgjorelse/",
    r"/sak/",
]

# Upper bounds (seconds) of the duration histogram.
DURATION_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 20.0]

# Text of the prompts and answers.
UNTITLED = "Uten tittel"
EMBEDDING_QUERY_INTRO = "Søk etter juridiske dokumenter om:"
EMBEDDING_QUERY_END = "Finn relevante dokumenter som direkte svarer på spørsmålet."
TRUNCATED_MARKER = "\n\n[... content truncated for embedding ...]\n\n"
SHORTENED_MARKER = "\n... [innhold forkortet] ...\n"
PROMPT_QUESTION = "Brukerspørsmål: "
PROMPT_SOURCES = "\n\nTilgjengelige kilder:\n"
PROMPT_END = (
    "\n\nInstruksjoner: Besvar spørsmålet ved å bruke kildene. "
    "Husk å returnere JSON-formatet som spesifisert."
)
PROMPT_NO_SOURCES = "\n\nIngen kilder ble funnet. Gi et forsiktig svar eller foreslå videre søk."
SUMMARY_INTRO = "Her er en oppsummering basert på tilgjengelige dokumenter:"
SUMMARY_EMPTY = (
    "Jeg fant ingen relevante dokumenter. "
    "Vurder å formulere spørsmålet på en annen måte eller begrense søket."
)
