"""Schemas of the graph's tables, as SQL type strings in file order; names with an underscore in front are read past."""

PERSON = "id bigint, first_name string, last_name string, gender string, birthday date, creation_date timestamp_ntz, location_ip string, browser_used string"
KNOWS = "p1 bigint, p2 bigint, creation_date timestamp_ntz"
PAIR = "{} bigint, {} {}"

#: table: (file, schema of the leading columns)
FILES = {
    "person": ("person_0_0.csv", PERSON),
    "knows": ("person_knows_person_0_0.csv", KNOWS),
    "located": ("person_isLocatedIn_place_0_0.csv", PAIR.format("person_id", "place_id", "bigint")),
    "place": ("place_0_0.csv", PAIR.format("id", "name", "string")),
    "speaks": ("person_speaks_language_0_0.csv", PAIR.format("person_id", "language", "string")),
    "email": ("person_email_emailaddress_0_0.csv", PAIR.format("person_id", "email", "string")),
    "study_at": ("person_studyAt_organisation_0_0.csv", "person_id bigint, org_id bigint, class_year bigint"),
    "work_at": ("person_workAt_organisation_0_0.csv", "person_id bigint, org_id bigint, work_from bigint"),
    "organisation": ("organisation_0_0.csv", "id bigint, type string, name string"),
    "org_located": ("organisation_isLocatedIn_place_0_0.csv", PAIR.format("org_id", "place_id", "bigint")),
    "comment": ("comment.csv", "id bigint, creation_date timestamp_ntz, _location_ip string, _browser_used string, content string"),
    "post": ("post.csv", "id bigint, image_file string, creation_date timestamp_ntz, _location_ip string, _browser_used string, _language string, content string"),
    "comment_creator": ("comment_hasCreator_person.csv", PAIR.format("message_id", "person_id", "bigint")),
    "post_creator": ("post_hasCreator_person.csv", PAIR.format("message_id", "person_id", "bigint")),
}
