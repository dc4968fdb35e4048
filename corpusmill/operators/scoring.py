"""How far a source is to be trusted: kind, recency, quality, place in a tree, and their mixtures.

Every score is an expression over columns; the day that counts as today is a parameter, so a run
can be repeated.  Metadata is a flat ``map<string, string>``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import folded, truthy

# What attachments call themselves.
APPENDIX_TITLE = r"(별표\s*(?:제)?\s*\d+(?:\s*의\s*\d+)?\s*호?)"
FORM_TITLE = r"(별지\s*(?:제)?\s*\d+(?:\s*의\s*\d+)?\s*호?\s*(?:서식)?|서식\s*(?:제)?\s*\d+(?:\s*의\s*\d+)?|서식|양식|신청서)"
NUMBERED_FORM_TITLE = r"(별지\s*(?:제)?\s*\d+(?:\s*의\s*\d+)?\s*호?\s*(?:서식)?|서식\s*(?:제)?\s*\d+(?:\s*의\s*\d+)?)"
# Steps of recency as (years, score), then older and unknown.
RECENCY = {
    "main": ([(0.5, 1.0), (1, 0.88), (2, 0.72), (3, 0.55), (5, 0.30)], 0.15, 0.35),
    "department": ([(0.5, 1.0), (1, 0.90), (2, 0.75), (3, 0.55), (5, 0.30)], 0.15, 0.35),
    "rule": ([(1, 1.0), (3, 0.8), (7, 0.55)], 0.3, 0.45),
}
# Base and span of the bands.
MAIN_BANDS = {"student_life": (0.60, 0.35), "notice": (0.35, 0.24)}
AUTHORITY_BANDS = {"school_rule": (0.90, 0.099), "regulation": (0.70, 0.199), "bylaw_guideline": (0.50, 0.199), "unknown": (0.35, 0.149)}
# Page roles by keyword.
PAGE_WORDS = ["학부안내", "학사안내", "학부소개", "전공소개", "대학원소개", "졸업요건", "교육과정", "모듈형교육과정"]
BOARD_WORDS = ["공지사항", "학과공지", "대학원공지", "산업대학원공지", "교육대학원공지", "취업", "채용"]
REPEALED_WORDS = ["폐지", "폐기", "삭제", "실효", "종료"]
# Topics of notices by what their metadata contains, first match wins.
TOPIC_ALIASES = [("공지사항", "notice"), ("비교과안내", "non_curricular"), ("학사안내", "academic"), ("등록·장학", "tuition_scholarship"), ("등록장학", "tuition_scholarship"), ("초빙·채용", "recruitment"), ("초빙채용", "recruitment")]


def meta(metadata: Column, *keys: str) -> Column:
    """The first of the keys that has a value that is not empty; null for none."""
    return F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in keys])


def first_case(cases: list[tuple[Column, object]], otherwise: object) -> Column:
    chosen = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(otherwise)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def recency(day: Column, today: dt.date, policy: str = "main") -> Column:
    """The recency step of a date; a date in the future counts as today."""
    steps, older, unknown = RECENCY[policy]
    years = F.greatest(F.datediff(F.lit(today), day), F.lit(0)) / 365.25
    return first_case([(day.isNull(), unknown), *((years <= y, s) for y, s in steps)], older)


def attachment_kind(*values: Column, numbered_only: bool = False) -> Column:
    """(kind, number) by what an attachment is called: appendix before form, '' for no name at all."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values]), r"(?U)\s+", " "))
    form = NUMBERED_FORM_TITLE if numbered_only else FORM_TITLE
    pick = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), (F.regexp_extract(text, pattern, 1) if pattern else F.lit("")).alias("number"))
    return first_case([(text == "", pick("rule_text" if numbered_only else "", None)), (text.rlike(APPENDIX_TITLE), pick("appendix_table", APPENDIX_TITLE)), (text.rlike(form), pick("form", form))], pick("attachment", None))


def document_kind(title: Column, metadata: Column, rules: bool = False) -> Column:
    """post (or rule_text), form, appendix_table or attachment: as declared, by flags, by names, by the kind of source."""
    declared = folded(meta(metadata, "document_kind", "attachment_kind"))
    names = [title, *[F.try_element_at(metadata, F.lit(k)) for k in ("doc_title", "source_file", "attachment_name", "source_path", *(["source_attachment_path"] if rules else []))]]
    text = folded(F.concat_ws("\n", *[F.coalesce(n, F.lit("")) for n in names]))
    default = "rule_text" if rules else "post"
    kind = folded(meta(metadata, "source_kind"))
    return first_case(
        [
            (declared.isin(default, "form", "appendix_table", "attachment"), declared),
            (truthy(meta(metadata, "is_form")), "form"), (truthy(meta(metadata, "is_appendix_table")), "appendix_table"),
            (text.rlike(APPENDIX_TITLE), "appendix_table"), (text.rlike(NUMBERED_FORM_TITLE if rules else FORM_TITLE), "form"),
            (kind == "file" if rules else kind.isin("attachment", "file"), "attachment"),
        ],
        default,
    )


def kind_adjustment(kind: Column, rules: bool = False) -> Column:
    return first_case([(kind == "form", -0.07 if rules else -0.12), (kind == "appendix_table", -0.035 if rules else -0.06)], 0.0)


def _length_part(content: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(F.greatest(F.length(F.coalesce(content, F.lit(""))), F.lit(10))) / 4.0)


def _naming_part(metadata: Column) -> Column:
    has = lambda *keys: F.when(folded(meta(metadata, *keys)) != "", 0.25).otherwise(0.0)
    return F.lit(0.5) + has("doc_title", "source_file") + has("doc_url", "source_page_url")


def source_quality(metadata: Column, content: Column) -> Column:
    return F.least(F.lit(1.0), 0.65 * _length_part(content) + 0.35 * _naming_part(metadata))


def rule_quality(metadata: Column, content: Column) -> Column:
    kind, ext = folded(meta(metadata, "source_kind")), folded(meta(metadata, "source_ext"))
    by_kind = first_case([(kind == "file", 1.0), (kind == "html", 0.85)], 0.75)
    by_ext = F.when(ext.isin(".hwp", ".hwpx", ".pdf", ".docx", ".doc"), F.greatest(by_kind, F.lit(0.95))).otherwise(by_kind)
    return F.least(F.lit(1.0), 0.45 * _length_part(content) + 0.35 * by_ext + 0.20 * _naming_part(metadata))


def page_role(title: Column, metadata: Column) -> Column:
    """(role, score) of a page of a department's site."""
    parts = [*[F.try_element_at(metadata, F.lit(k)) for k in ("category", "subcategory", "doc_type", "doc_title", "source_file")], title]
    text = folded(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]))
    role = lambda name, score: F.struct(F.lit(name).alias("role"), F.lit(score).alias("score"))
    any_of = lambda words: text.rlike("|".join(words))
    return first_case([(any_of(PAGE_WORDS), role("department_page", 1.0)), (any_of(BOARD_WORDS), role("notice_or_job_board", 0.45))], role("general_department_content", 0.65))


def authority(metadata: Column, tree_kind: Column) -> Column:
    """school_rule, regulation, bylaw_guideline or unknown: by the tree, then by the metadata."""
    tree, sub, kind = folded(tree_kind), folded(meta(metadata, "subcategory")), folded(meta(metadata, "doc_type"))
    return first_case(
        [
            (tree == "hak", "school_rule"), (tree == "gyu", "regulation"), (tree.isin("se", "ji"), "bylaw_guideline"),
            ((sub == "school_rule") | (kind == "hak"), "school_rule"), ((sub == "regulation") | (kind == "gyu"), "regulation"),
            (sub.isin("bylaw", "guideline") | kind.isin("bylaw_guideline", "se", "ji"), "bylaw_guideline"),
        ],
        "unknown",
    )


def tree_score(kind: Column, in_tree: Column, depth: Column) -> Column:
    """By the depth of the node; a depth that is no number counts as 3."""
    d = F.coalesce(depth.try_cast("int"), F.lit(3))
    return first_case(
        [
            (~in_tree & kind.isin("school_rule", "regulation"), 0.50), (~in_tree, 0.35),
            ((kind == "school_rule") & (d <= 1), 1.0), (kind == "school_rule", 0.90),
            ((kind == "regulation") & (d <= 2), 1.0), ((kind == "regulation") & (d == 3), 0.80), (kind == "regulation", 0.65),
            ((kind == "bylaw_guideline") & (d <= 2), 0.85), ((kind == "bylaw_guideline") & (d == 3), 0.70), (kind == "bylaw_guideline", 0.55),
        ],
        0.40,
    )


def is_repealed(title: Column, content: Column) -> Column:
    return folded(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(F.coalesce(content, F.lit("")), F.lit(1000)))).rlike("|".join(REPEALED_WORDS))


def main_score(band: str, overlap: Column, recent: Column, quality: Column, adjustment: Column) -> Column:
    base, span = MAIN_BANDS[band]
    return clamp(F.lit(base) + span * clamp(0.45 * overlap + 0.35 * recent + 0.20 * quality + adjustment))


def department_score(total: Column, rule_overlap: Column, main_overlap: Column, recent: Column, page: Column, adjustment: Column) -> Column:
    """0 for a document without features."""
    mixed = 0.38 * F.greatest(rule_overlap, main_overlap) + 0.27 * recent + 0.30 * page + 0.05 * F.least(F.lit(1.0), rule_overlap + main_overlap) + adjustment
    return F.when(total <= 0, 0.0).otherwise(clamp(mixed))


def rule_score(kind: Column, recent: Column, tree: Column, quality: Column, adjustment: Column, is_top: Column | None = None) -> Column:
    """Within the band of the authority; the top rule itself has 1."""
    base = first_case([(kind == k, b) for k, (b, _) in AUTHORITY_BANDS.items()], 0.35)
    span = first_case([(kind == k, s) for k, (_, s) in AUTHORITY_BANDS.items()], 0.149)
    score = clamp(base + span * (0.50 * recent + 0.35 * tree + 0.15 * quality) + adjustment)
    return score if is_top is None else F.when(is_top, 1.0).otherwise(score)


def is_top_rule(title: Column, metadata: Column, names: list[str]) -> Column:
    """A rule that carries one of ``names`` (an institution's own statutes) and is of the school's kind."""
    text = folded(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(meta(metadata, "doc_title"), F.lit("")), F.coalesce(meta(metadata, "source_file"), F.lit(""))))
    named = F.lit(False)
    for name in names:
        named = named | text.contains(name.lower())
    return named & ((folded(meta(metadata, "subcategory")) == "school_rule") | (folded(meta(metadata, "doc_type")) == "hak"))


def notice_topic(metadata: Column) -> Column:
    text = F.concat_ws("\n", *[F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in ("category", "subcategory", "doc_title", "source_file", "source_path")])
    return first_case([(text.contains(alias), topic) for alias, topic in TOPIC_ALIASES], "")


@dataclass(frozen=True)
class SourceType:
    """What a source is when nothing says so."""

    attachment: str = "attachment"
    web: str = "web"
    unknown: str = "unknown"

    def of(self, ext: Column, attachment_url: Column, url: Column) -> Column:
        bare = F.regexp_replace(F.lower(F.trim(F.coalesce(ext, F.lit("")))), r"^\.", "")
        some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
        return first_case([(bare != "", bare), (some(attachment_url), self.attachment), (some(url), self.web)], self.unknown)
