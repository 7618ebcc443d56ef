"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much is rejected.

A line (cut at newlines) fails
- punctuation: if it has a word and over `most_symbols` symbols `[#*$%&|<>]` a word, or over `most_shouts` words
  ending in `!!` a word;
- navigation: if it has three or more ` | ` or ` > ` or ` » ` separators, or all its words are known menu words;
- boilerplate: if it has a phrase of the list below and 15 words or fewer;
- repetition: if an equal line with a word came earlier in the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import word_list

#: Lower-case phrases of notices, in English, German, French and Spanish; a short line that has one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "terms of service", "terms of use", "privacy policy", "cookie policy", "accept cookies", "use cookies", "subscribe to our", "sign up for our", "javascript is disabled", "enable javascript", "licensed under", "released under the", "this work is licensed", "lorem ipsum", "share this", "powered by",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "verwendet cookies", "newsletter abonnieren",
    "tous droits réservés", "conditions générales", "politique de confidentialité", "accepter les cookies", "utilise des cookies", "abonnez-vous",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "aceptar cookies", "utiliza cookies", "suscríbete a",
)
#: Lower-case words of menus, in the same languages.
MENU = (
    "home", "about", "contact", "login", "logout", "register", "search", "menu", "next", "previous", "back", "top", "share", "print", "help", "faq", "sitemap", "subscribe",
    "startseite", "kontakt", "impressum", "datenschutz", "anmelden", "abmelden", "suche", "weiter", "zurück", "hilfe", "drucken", "teilen",
    "accueil", "connexion", "recherche", "suivant", "précédent", "retour", "partager", "imprimer", "aide",
    "inicio", "contacto", "buscar", "menú", "siguiente", "anterior", "volver", "compartir", "imprimir", "ayuda",
)

SYMBOL = re.compile(r"[#*$%&|<>]")
SEPARATOR = re.compile(r" (?:\||>|») ")


def line_fails(line: str, words: list[bytes], most_symbols: float, most_shouts: float) -> bool:
    """Whether a line with these words (one or more) breaks a rule that needs no other line."""
    n = len(words)
    if len(SYMBOL.findall(line)) > most_symbols * n or sum(w.rstrip(b".,").endswith(b"!!") for w in words) > most_shouts * n:
        return True
    if len(SEPARATOR.findall(line)) >= 3:
        return True
    low = line.lower()
    if n <= 15 and any(phrase in low for phrase in BOILERPLATE):
        return True
    return n <= 15 and all(w.decode("utf-8", "surrogatepass").lower() in MENU for w in words)


def judge(text: str | None, most_symbols: float, most_shouts: float, least_words: int, most_repeat: int, most_lost: float) -> tuple:
    words = word_list(text)
    n = len(words)
    text = text or ""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    repeated = 0
    if len(counts) < len(windows):
        done = 0
        for i, window in enumerate(windows):
            if counts[window] > 1:
                repeated += i + 3 - max(i, done)
                done = i + 3
    kept, kept_words, dup, seen = [], 0, 0, set()
    for line in text.split("\n"):
        own = word_list(line)
        if not own:
            kept.append(line)
            continue
        if line in seen:
            dup += 1
            continue
        seen.add(line)
        if not line_fails(line, own, most_symbols, most_shouts):
            kept.append(line)
            kept_words += len(own)
    base_failed = n < least_words or 100 * repeated > most_repeat * n
    return n, sum(map(len, (w.decode("utf-8", "surrogatepass") for w in words))), len(SYMBOL.findall(text)), dup, repeated, base_failed, not base_failed and n - kept_words <= most_lost * n, kept_words, "\n".join(kept)


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_symbols: float = 0.25, most_shouts: float = 0.5, least_words: int = 50, most_repeat: int = 50, most_lost: float = 0.5, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, n_kept_words and clean_text (the lines that pass) of each document, and
    before them the columns named in `keep`.

    A null or empty text has no words and fails the base rules. Every row is judged by itself, however often it
    comes; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(t, most_symbols, most_shouts, least_words, most_repeat, most_lost) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words", "clean_text"])
            batch = batch.drop(columns="text").reset_index(drop=True)
            yield pd.concat([batch.astype({"doc_id": "Int64"}), out], axis=1)

    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kinds = "".join(f"{name} {kind}, " for name, kind in rows.select(*names).dtypes)
    schema = kinds + "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_kept_words long, clean_text string"
    out = rows.mapInPandas(run, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *out.columns[len(keep) :])
