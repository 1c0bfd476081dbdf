"""The five record kinds as Spark types. Non-nullable fields are required, nullable ones optional."""

from pyspark.sql import types as T


def _record(*fields: tuple[str, T.DataType], optional: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name in optional) for name, kind in fields])


TEXT = T.StringType()
TEXTS = T.ArrayType(TEXT, containsNull=False)

VOICE_PROFILE = _record(
    ("tone", TEXT),
    ("sentence_structure", TEXT),
    ("vocabulary_level", TEXT),
    ("formatting_quirks", TEXT),
    ("common_transitions", TEXTS),
    ("forbidden_words", TEXTS),
)
RESUME_STRUCTURE = _record(
    ("bullet_style", TEXT),
    ("section_ordering", TEXTS),
    ("metric_usage", TEXT),
    ("density", TEXT),
)
AUTHOR_STYLE = _record(
    ("voice_profile", VOICE_PROFILE),
    ("resume_structure_preferences", RESUME_STRUCTURE),
)
JOB_CONTEXT = _record(
    ("job_title", TEXT),
    ("company_name", TEXT),
    ("company_description", TEXT),
    ("location", TEXT),
    ("team_or_department", TEXT),
    ("key_responsibilities", TEXTS),
    ("required_skills", TEXTS),
    ("preferred_skills", TEXTS),
    ("culture_signals", TEXTS),
    ("seniority_level", TEXT),
    ("remote_policy", TEXT),
    ("salary_range", TEXT),
)
TAILORING_STRATEGY = _record(
    ("positioning_angle", TEXT),
    (
        "experiences_to_emphasize",
        T.ArrayType(
            _record(
                ("company", TEXT),
                ("title", TEXT),
                ("reason", TEXT),
                ("bullets_to_highlight", TEXTS),
            ),
            containsNull=False,
        ),
    ),
    ("skills_to_highlight", TEXTS),
    (
        "skills_gap_strategy",
        T.ArrayType(_record(("missing_skill", TEXT), ("mitigation", TEXT)), containsNull=False),
    ),
    ("cover_letter_hooks", TEXTS),
    ("resume_summary_angle", TEXT),
)
GENERATION_OUTPUT = _record(
    ("cover_letter", TEXT),
    ("resume_content", TEXT),
    ("template_variables", T.MapType(TEXT, TEXT, valueContainsNull=False)),
    optional=("template_variables",),
)
EXPERIENCE = _record(
    ("title", TEXT),
    ("company", TEXT),
    ("location", TEXT),
    ("start_date", TEXT),
    ("end_date", TEXT),
    ("bullets", TEXTS),
)
EDUCATION = _record(("degree", TEXT), ("school", TEXT), ("graduation_year", T.DoubleType()))
USER_PROFILE = _record(
    ("name", TEXT),
    ("email", TEXT),
    ("phone", TEXT),
    ("location", TEXT),
    ("linkedin", TEXT),
    ("summary", TEXT),
    ("skills", TEXTS),
    ("experience", T.ArrayType(EXPERIENCE, containsNull=False)),
    ("education", T.ArrayType(EDUCATION, containsNull=False)),
    optional=("phone", "location", "linkedin"),
)
