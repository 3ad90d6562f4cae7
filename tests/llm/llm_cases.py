"""Prose in three languages and helpers of the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = {
    "en": "the of and with that there from this other then which their about would these",
    "de": "und der die nicht einer werden sich auch wurde durch zwischen über schön straße",
    "fr": "le les des une dans être avec pour mais où très élève garçon français après",
}


def prose(lang: str, seed: int, n: int = 120) -> str:
    words = WORDS[lang].split()
    out, x = [], seed * 2654435761 % 2**32
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out.append(words[(x >> 16) % len(words)])
        if (x >> 8) % 11 == 0:
            out[-1] += ".\n"
    return " ".join(out)


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
