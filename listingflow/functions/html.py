"""Columns over raw HTML: built-in regular expressions, no parser in the hot path."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_text

# Everyday entities; other names and numbers go to the text library Spark ships.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"),
            ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘")]
_KNOWN = "lt|gt|quot|#39|apos|nbsp|copy|middot|ndash|mdash|hellip|rsquo|lsquo|amp"
_RARE = rf"&(?!(?:{_KNOWN});)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);"


def unescape(c: Column, rare_entities: bool = True) -> Column:
    out = c
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    if not rare_entities:
        return out
    named = F.java_method(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"),
                          F.replace(c, F.lit("&apos;"), F.lit("'")))
    return F.when(c.rlike(_RARE), named).otherwise(out)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def heading(html: Column, level: int = 1) -> Column:
    return F.regexp_extract(html, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", 1)


def without_hidden(html: Column) -> Column:
    """Markup that is never text: comments, scripts, styles, noscript blocks."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>", "")


def markup_to_text(html: Column, rare_entities: bool = True) -> Column:
    """Text of a fragment: breaks after br/p/li/tr/h1-h4 only, blanks between other tags."""
    broken = F.regexp_replace(without_hidden(html), r"(?i)<br\b[^>]*>|</(?:p|li|tr|h[1-4])\s*>", "\n")
    return clean_text(unescape(F.regexp_replace(broken, r"(?s)<[^>]*>", " "), rare_entities))


def inline_text(html: Column, rare_entities: bool = True) -> Column:
    """Text of a title or link: tags become blanks, all white space collapses."""
    flat = unescape(F.regexp_replace(html, r"(?s)<[^>]*>", " "), rare_entities)
    return F.trim(F.regexp_replace(flat, r"(?U)\s+", " "))
