"""Read schemas of the nested sources and of the warehouse tables, as DDL."""

LISTING_A = """jobs ARRAY<STRUCT<id: BIGINT, title: STRING, absolute_url: STRING, updated_at: STRING,
  first_published: STRING, location: STRUCT<name: STRING>, company_name: STRING, content: STRING,
  departments: ARRAY<STRUCT<name: STRING>>, offices: ARRAY<STRUCT<name: STRING>>>>"""

LISTING_B = """jobs ARRAY<STRUCT<id: STRING, title: STRING, department: STRING, team: STRING,
  location: STRING, publishedAt: STRING, isListed: BOOLEAN, isRemote: BOOLEAN,
  workplaceType: STRING, jobUrl: STRING, applyUrl: STRING, descriptionPlain: STRING,
  descriptionHtml: STRING>>"""

LISTING_C = """id STRING, text STRING, hostedUrl STRING, applyUrl STRING, createdAt BIGINT,
  categories STRUCT<location: STRING, team: STRING, commitment: STRING>,
  descriptionPlain STRING, description STRING"""

FORM = """id BIGINT, title STRING,
  questions ARRAY<STRUCT<label: STRING, description: STRING, required: BOOLEAN,
    fields: ARRAY<STRUCT<name: STRING, type: STRING,
      values: ARRAY<STRUCT<label: STRING, value: STRING>>>>>>,
  demographic_questions STRUCT<questions: ARRAY<STRING>>,
  compliance ARRAY<STRUCT<type: STRING, requires_consent: BOOLEAN>>"""

# Fields in alphabetical order, so that to_json gives a canonical text.
FILTERS = """STRUCT<company: STRING, days: INT, level: STRING,
  place: STRUCT<label: STRING, terms: ARRAY<STRING>>, skills: ARRAY<STRING>,
  words: ARRAY<STRING>, workplace: STRING>"""

ROLE = """STRUCT<title: STRING, company: STRING, start: STRING, end: STRING, location: STRING,
  bullets: ARRAY<STRING>>"""

FIELDS = """ARRAY<STRUCT<name: STRING, kind: STRING,
  options: ARRAY<STRUCT<label: STRING, value: STRING>>>>"""

POSTING_COLUMNS = (
    "posting_id", "vendor", "board", "external_id", "title", "company", "location", "department",
    "office", "url", "posted_at", "first_published", "html", "workplace_stated", "form_publishable",
)
