"""Scalar functions of the engine as SQL in either dialect: text, names, places, dates, closed vocabularies, page rules."""

from __future__ import annotations

from foliant.plans.dialect import Spark, quoted

# Vocabularies and patterns that results have to agree on.
CONNECTORS = ("bin", "bint", "al", "el", "ul", "ibn")
NAME_STOPWORDS = ("slave", "slaves", "woman", "man", "boy", "girl", "unknown", "unnamed", "agency", "resident", "secretary", "captain", "major", "sheikh", "shaikh", "political", "residency", "certificate", "statement", "memorandum", "telegram", "master", "owner", "buyer", "seller", "agent", "office")
PLACE_STOPWORDS = ("unknown", "unclear", "none", "nil", "there", "here", "this agency", "the agency", "agency", "residency", "political agency", "residency agency", "office", "record", "statement", "memorandum", "certificate", "arrival")
PLACE_MAP = {"shargah": "Sharjah", "sharjeh": "Sharjah", "sharjah": "Sharjah", "dibai": "Dubai", "debai": "Dubai", "dubai": "Dubai", "bahrein": "Bahrain", "bahrain": "Bahrain", "bushire": "Bushehr", "busheir": "Bushehr", "bushehr": "Bushehr", "mekran": "Mekran", "mokran": "Mekran", "henjam": "Henjam", "honjam": "Henjam", "ras ul khaimah": "Ras al Khaimah", "ras al khaimah": "Ras al Khaimah", "umm al quwain": "Umm al Quwain", "umm ul quwain": "Umm al Quwain", "muscat": "Muscat", "mascat": "Muscat", "zanzibar": "Zanzibar", "abyssinia": "Abyssinia", "abisinia": "Abyssinia"}
PROSE = ("without", "pressure", "slightest", "either", "would", "find", "way")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
REPORT_TYPES = ("statement", "correspondence")
LEGACY_TYPES = ("transport/admin", "investigation/correspondence", "official correspondence")
SKIP_REASONS = ("index", "record_metadata", "bad_ocr")
CONFLICTS = ("manumission dispute", "ownership dispute", "debt dispute", "free-status dispute", "forced-transfer dispute", "repatriation dispute", "kidnapping case")
CORRESPONDENCE = r"(?is)\b(repatriation|repatriate|passage|transport|taken\s+to|sent\s+to|for\s+delivery\s+to|delivered\s+to|arrange(?:d)?\s+.*?\s+for|maintenance|subsistence|provisions?\s+issued|victualled|accommodated\s+on\s+board|provision\s+account|certificate\s+delivered|grant\s+certificate|manumission\s+certificate|hand\s+him\s+over|made\s+over\s+to)\b"
STATEMENT = r"(?i)\b(statement\s+of|statement\s+made\s+by|i\s+was\s+born|i\s+was\s+kidnapped|i\s+request)\b"
INDEX = r"(?i)\b(index|contents|list\s+of\s+papers|table\s+of\s+contents)\b"
RECORD = r"(?i)\b(holding institution|about this record|view on the qatar digital library|open government licence|reference:\s*ior/|copyright for this page|written in english and arabic|extent and format)\b"
#: Texts that tell of a move, of an arrival, and of one that is only asked for.
MOVED = r"(?i)\b(arriv(e|ed|ing)|reached|escaped\s+to|took\s+refuge\s+at|went\s+to|came\s+to|brought\s+(me\s+)?to|taken\s+to|sent\s+to|forwarded|moved\s+to)\b"
ARRIVED = r"(?i)\b(arriv(ed|ing)|reached|escaped\s+to|went\s+to|came\s+to)\b"
ASKED = r"(?i)\b(request(ed)?|desired|wish(ed|es)?|intend(ed)?|propos(ed|es)|recommended|recommendation|delivery|certificate|office|agency|administrative|handling|not\s+clearly\s+completed)\b"
#: Where a letter was sent from, where someone arrived, and when; the last has the place as group 1 too.
SENT_FROM = r"(?im)^\s*from\s*-\s*(?:.*?,\s*)?([A-Za-z][A-Za-z' -]+?)\.\s*$"
ARRIVING = r"(?i)arriv(?:ing|ed)\s+(?:at\s+|in\s+|to\s+)?([A-Za-z][A-Za-z' -]*[A-Za-z])(?:\s+(?:about\s+the|on|about)\b|[.,;\n])"
ARRIVING_WHEN = r"(?i)arriv(?:ing|ed)\s+(?:at\s+|in\s+|to\s+)?([A-Za-z][A-Za-z' -]*[A-Za-z])\s+(?:about\s+the|on|about)\b([^.,;\n]+)"
CONFIDENCES = ("", "explicit", "derived_from_doc", "unknown")
#: Roles by what stands around a name, in the order in which they count; the name is {name}, in lower case as all else.
ROLES_AGAINST = {
    "sold_to_buyer": r"\bsold\s+(?:me\s+)?to\s+(?:one\s+)?{name}",
    "bought_by_owner": r"\bbought\s+by\s+{name}",
    "belonging_to_owner": r"\bbelonging\s+to\s+{name}",
    "owner_named": r"\bowner\s+(?:named\s+)?{name}",
    "master_named": r"\bmaster\s+(?:named\s+)?{name}",
    "recorded_by": r"\bstatement\s+recorded\s+by\s+{name}",
    "letter_from": r"\bletter\s+from\s+{name}",
    "signed_by": r"\bsigned\s+before\s+me\s+by\s+{name}",
    "official_title_context": r"\b(?:major|captain|shaikh|sheikh|secretary|agent|political\s+agent|resident|clerk|witness|signatory)\b.*{name}|{name}.*\b(?:major|captain|shaikh|sheikh|secretary|agent|political\s+agent|resident|clerk|witness|signatory)\b",
}
ROLES_FOR = {
    "statement_of_subject": r"\bstatement\s+of\s+(?:slave\s+)?{name}",
    "statement_by_subject": r"\bstatement\s+made\s+by\s+{name}",
    "slave_name": r"\bslave\s+{name}",
    "named_slave_forward": r"\bslave\b.*?\bnamed\s+{name}",
    "named_slave_reverse": r"\bnamed\s+{name}.*?\bslave\b",
    "single_slave_named": r"\b1\s+slave\b.*?\bnamed\s+{name}",
    "refugee_group": r"\brefugee\s+slaves?\b.*?{name}",
    "delivery_to": r"\bfor\s+delivery\s+to\s+{name}",
    "grant_certificate": r"\bgrant\b.*?\bcertificate\b.*?\bto\s+{name}",
    "recommend_certificate": r"\brecommend\b.*?\bcertificate\b.*?\bfor\s+{name}",
    "manumission_context": r"\bmanumission\b.*?{name}",
    "free_status_context": r"\bfree\s+status\b.*?{name}",
    "repatriation_request": r"{name}.*?\brequests?\s+repatriation\b",
}
STRONG_PHRASES = ("slave named", "refugee slave", "fugitive slave", "statement of slave", "statement made by", "grant certificate to", "recommend certificate for", "requests repatriation")
#: What stands for a name in a text, so that patterns are the same for every row.
MARK = "\u25a1"
EMPTY_PAGE = "[OCR_EMPTY]"
EDGES = " ,.;:[]{}\"'"
#: Unicode's white space, as a class that both engines read alike.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Runs of white space that aren't one space.
ODD_SPACE = f"{SPACE.replace('\\x1c-\\x20', '\\x1c-\\x1f')}{SPACE}*| {SPACE}+"


def one_of(x: str, words) -> str:
    return f"{x} in ({', '.join(map(quoted, words))})"


def spaced(d: Spark, x: str) -> str:
    """White space runs become one space, none at the ends."""
    if d.name == "spark":  # where words are one space apart nothing is replaced
        return f"trim({d.replace(f"coalesce({x}, '')", ODD_SPACE, ' ')})"
    return f"trim({d.replace(f"coalesce({x}, '')", SPACE + '+', ' ')})"


def stripped(d: Spark, x: str) -> str:
    return d.replace(f"coalesce({x}, '')", f"^{SPACE}+|{SPACE}+\\z")


def first_words(d: Spark, x: str, n: int = 25) -> str:
    if d.name == "spark":
        return f"substring_index({spaced(d, x)}, ' ', {n})"
    return d.each(d.words(spaced(d, x), n), "w")


def _capital(w: str = "w") -> str:
    return f"concat(upper(substring({w}, 1, 1)), lower(substring({w}, 2)))"


def _trimmed(d: Spark, x: str) -> str:
    signs = r"[ ,.;:\[\]{}\x22\x27]+"
    return d.replace(d.replace(d.accents(spaced(d, x)), "^" + signs), signs + "$")


def _unbracketed(d: Spark, x: str) -> str:
    return spaced(d, d.replace(x, r"\s*\([^)]*\)\s*", " "))


def name(d: Spark, x: str) -> str:
    s = d.replace(_trimmed(d, x), r"(?i)^(?:the\s+)?slave\s+")
    s = _unbracketed(d, d.replace(s, r"(?i)^(?:mr|mrs|miss|mst)\.?\s+"))
    word = f"case when lower(w) = 'ibn' then 'bin' when {one_of('lower(w)', CONNECTORS + ('daughter', 'son', 'of'))} then lower(w) else {_capital()} end"
    return d.each(d.words(s), word)


def valid_name(d: Spark, n: str) -> str:
    """n: a normalised name."""
    stop = d.any(d.words(n), one_of("lower(w)", NAME_STOPWORDS))
    return f"(length({n}) >= 2 and not {d.like(n, r'\p{Nd}')} and not ({stop} and {d.size(d.words(n))} <= 2) and {d.count(n, r'\p{L}')} >= 2)"


def candidate_name(d: Spark, n: str) -> str:
    return f"({valid_name(d, n)} or (not {d.like(n, r'\p{Nd}')} and {d.size(d.words(n))} >= 2 and {d.count(n, r'\p{L}')} >= 4))"


def place(d: Spark, x: str) -> str:
    s = _unbracketed(d, d.replace(_trimmed(d, x), r"(?i)^(?:at|in|to|from|near|via)\b\s+"))
    low = d.replace(f"replace(lower({s}), '-', ' ')", r"\s+", " ")
    return d.lookup(low, {k: quoted(v) for k, v in PLACE_MAP.items()}, d.each(d.words(s, 6), f"case when lower(w) in ('al', 'ul', 'el') then lower(w) else {_capital()} end"))


def valid_place(d: Spark, p: str) -> str:
    """p: a normalised place."""
    low = f"lower({p})"
    words = d.words(f"trim({d.replace(low, '[^a-z]+', ' ')})")
    prose = f"({d.size(words)} >= 4 and {d.any(words, one_of('w', PROSE))})"
    ship = d.like(low, r"\b(h\.m\.s\.?|s\.s\.?|steamship|ship|dhow|vessel|boat)\b")
    return f"({p} <> '' and not {d.like(p, r'\p{Nd}')} and not {one_of(low, PLACE_STOPWORDS)} and not {d.like(low, '^[^a-z]*(without|if|when)([^a-z]|$)')} and not {prose} and not {ship})"


def year(d: Spark, x: str) -> str:
    return f"cast(nullif({d.extract(f"coalesce({x}, '')", r'\b(?:17|18|19|20)[0-9]{2}\b')}, '') as int)"


def month(d: Spark, x: str) -> str:
    return d.lookup(f"lower(substring({x}, 1, 3))", {m: str(k) for k, m in enumerate(MONTHS, 1)}, "0")


def iso_date(d: Spark, x: str, doc_year: str) -> tuple[str, str]:
    """SQL of the date and of its confidence; x: a text with spaced() applied, doc_year: an int or null. Month names count by their first three letters and have to have them."""
    number = r"(?i)([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{2,4})\b"
    american, english, short = r"\b([A-Za-z]{3,})\s+([0-9]{1,2}),\s*([0-9]{4})\b", r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,})\s+([0-9]{4})\b", r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+([a-z]+)\b"
    low = spaced(d, f"replace(lower({x}), ',', ' ')")
    part = lambda p, g, of=x: f"coalesce(cast(nullif({d.extract(of, p, g)}, '') as int), 0)"
    written = lambda y, m, day: f"concat(lpad(cast({y} as string), 4, '0'), '-', lpad(cast({m} as string), 2, '0'), '-', lpad(cast({day} as string), 2, '0'))"
    if d.name == "oracle":
        written = lambda y, m, day: f"concat(lpad(cast({y} as varchar), 4, '0'), '-', lpad(cast({m} as varchar), 2, '0'), '-', lpad(cast({day} as varchar), 2, '0'))"
    good = lambda m, day: f"({m} between 1 and 12 and {day} between 1 and 31)"
    nd, nm, ny = part(number, 1), part(number, 2), part(number, 3)
    century = f"(case when {ny} >= 100 then {ny} when coalesce({doc_year}, 0) > 0 then {doc_year} - {doc_year} % 100 + {ny} else 1900 + {ny} end)"
    am, ad, ay = month(d, d.extract(x, american, 1)), part(american, 2), part(american, 3)
    em, ed, ey = month(d, d.extract(x, english, 2)), part(english, 1), part(english, 3)
    sm, sd = month(d, d.extract(low, short, 2)), part(short, 1, low)
    arms = [
        (d.like(x, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), x, "'explicit'"),
        (good(nm, nd), written(century, nm, nd), f"case when {ny} < 100 then 'derived_from_doc' else 'explicit' end"),
        (good(am, ad), written(ay, am, ad), "'explicit'"),
        (good(em, ed), written(ey, em, ed), "'explicit'"),
        (f"(coalesce({doc_year}, 0) > 0 and {good(sm, sd)})", written(doc_year, sm, sd), "'derived_from_doc'"),
    ]
    case = lambda k: "case " + " ".join(f"when {a[0]} then {a[k]}" for a in arms) + " else '' end"
    return case(1), case(2)


def report_type(d: Spark, x: str) -> str:
    s = spaced(d, x)
    return f"case when {one_of(f'lower({s})', LEGACY_TYPES)} then 'correspondence' when {one_of(s, REPORT_TYPES)} then {s} else 'correspondence' end"


def overridden(d: Spark, text: str, current: str) -> str:
    s = spaced(d, text)
    return f"case when {d.like(s, STATEMENT)} then 'statement' when {d.like(s, CORRESPONDENCE)} then 'correspondence' else {current} end"


def bad_page(d: Spark, text: str) -> str:
    s = spaced(d, text)
    tokens, noise = d.count(s, "[a-zA-Z]{2,}"), d.count(s, r"[^a-zA-Z0-9\s]")
    return f"({s} in ('', '{EMPTY_PAGE}') or (length({s}) < 24 and {tokens} < 4) or ({noise} > length({s}) * 0.4D and {tokens} < 6))" if d.name == "spark" else f"({s} in ('', '{EMPTY_PAGE}') or (length({s}) < 24 and {tokens} < 4) or ({noise} > length({s}) * 0.4 and {tokens} < 6))"


def skip_reason(d: Spark, x: str) -> str:
    low = f"lower({spaced(d, x)})"
    return f"case when {one_of(low, SKIP_REASONS)} then {low} else '' end"


def cleaned(d: Spark, x: str) -> str:
    s = stripped(d, x)
    return f"case when lower({s}) in ('none', 'null') then '' else {s} end"


def allowed(d: Spark, x: str, words) -> str:
    """The allowed spelling, else empty."""
    return d.lookup(f"lower({spaced(d, x)})", {w.lower(): quoted(w) for w in words}, "''")


def doc_id(d: Spark, x: str) -> str:
    """Characters that paths can't have become _; spaces and dots at the ends go."""
    s = d.replace(spaced(d, d.replace(f"coalesce({x}, '')", r"[\\/:*?\x22<>|\x00-\x1f]+", "_")), r"^[ .]+")
    return d.replace(s, r"[ .]+$")


def confident_move(d: Spark, x: str) -> str:
    return d.like(x, MOVED)


def uncertain_move(d: Spark, x: str) -> str:
    return f"({d.like(x, ASKED)} and not {d.like(x, ARRIVED)})"


def plausible_place(d: Spark, p: str) -> str:
    """p: a normalised place that was inferred: at most four words and none of prose."""
    words = d.words(f"trim({d.replace(f'lower({p})', '[^a-z]+', ' ')})")
    return f"({valid_place(d, p)} and {d.size(words)} between 1 and 4 and not {d.any(words, one_of('w', PROSE))})"


def marked(d: Spark, text: str, n: str) -> str:
    """The text in lower case, without accents, and with a mark for the normalised name n where it stands as whole words."""
    low = f"concat(' ', lower({d.accents(spaced(d, text))}), ' ')"
    apart = d.replace(low, "([^a-z0-9' -])", " \\1 ") if d.name == "oracle" else d.replace(low, "([^a-z0-9' -])", " $1 ")
    return spaced(d, f"replace({apart}, concat(' ', lower({n}), ' '), ' {MARK} ')")


def first_role(d: Spark, marked_text: str, roles: dict[str, str]) -> str:
    arms = " ".join(f"when {d.like(marked_text, p.replace('{name}', MARK))} then {quoted(k)}" for k, p in roles.items())
    return f"case {arms} else '' end"


def free_born(d: Spark, low: str) -> str:
    return f"({d.like(low, r'\bfree\s*born\b')} and {d.like(low, r'\bnot\s+a?\s*slave\b')})"


def first_phrase(low: str) -> str:
    arms = " ".join(f"when instr({low}, {quoted(p)}) > 0 then {quoted(p)}" for p in STRONG_PHRASES)
    return f"case {arms} else '' end"
