"""Contact masks and card masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import text as X
from riskloom.plans.bridge import BankTables
from riskloom.plans.catalog.registry import query, view

# Contacts in every shape: missing, empty, without @, with several @, short numbers, channel prefix.
view("contacts", """
SELECT customer_id, CASE WHEN customer_id LIKE '%11' THEN '' WHEN customer_id LIKE '%22' THEN 'sin arroba ' || last_name
         WHEN customer_id LIKE '%33' THEN '@' || email WHEN customer_id LIKE '%44' THEN replace(email, '.', ' ')
         ELSE email END AS email,
       CASE WHEN customer_id LIKE '%15' THEN '' WHEN customer_id LIKE '%26' THEN 'x12' WHEN customer_id LIKE '%37' THEN NULL
         WHEN customer_id LIKE '%48' THEN 'whatsapp:' || mobile_phone WHEN customer_id LIKE '%59' THEN mobile_phone || '99999999'
         ELSE mobile_phone END AS phone
FROM customers""")


def contacts(t: BankTables):
    def like(end):
        return F.col("customer_id").endswith(end)
    email = (F.when(like("11"), "").when(like("22"), F.concat(F.lit("sin arroba "), "last_name"))
              .when(like("33"), F.concat(F.lit("@"), "email")).when(like("44"), F.replace("email", F.lit("."), F.lit(" ")))
              .otherwise(F.col("email")))
    phone = (F.when(like("15"), "").when(like("26"), "x12").when(like("37"), None)
              .when(like("48"), F.concat(F.lit("whatsapp:"), "mobile_phone"))
              .when(like("59"), F.concat("mobile_phone", F.lit("99999999"))).otherwise(F.col("mobile_phone")))
    return t.customers.select("customer_id", email.alias("email"), phone.alias("phone"))


@query("mask_email", r"""
SELECT customer_id, CASE WHEN email LIKE '%@%' THEN CASE WHEN email LIKE '@%' THEN '' ELSE left(email, 1) END || '***@'
       || substr(email, strpos(email, '@') + 1) ELSE email END AS masked FROM contacts""")
def mask_email(t: BankTables):
    return contacts(t).select("customer_id", X.mask_email(F.col("email")).alias("masked"))


@query("mask_phone", r"""
SELECT customer_id, CASE WHEN phone IS NULL OR phone = '' THEN phone WHEN length(regexp_replace(phone, '\D', '', 'g')) >= 4
       THEN '***' || right(regexp_replace(phone, '\D', '', 'g'), 4) ELSE '***' END AS masked FROM contacts""")
def mask_phone(t: BankTables):
    return contacts(t).select("customer_id", X.mask_phone(F.col("phone")).alias("masked"))


@query("valid_email", r"""
SELECT customer_id, coalesce(email LIKE '%@%' AND email NOT LIKE '% %' AND
       list_last(string_split(email, '@')) LIKE '%.%', false) AS valid FROM contacts""")
def valid_email(t: BankTables):
    return contacts(t).select("customer_id", X.valid_email(F.col("email")).alias("valid"))


@query("valid_phone", r"""
SELECT customer_id, coalesce(regexp_full_match(replace(replace(phone, 'whatsapp:', ''), ' ', ''), '\+[0-9]{8,15}'), false)
       AS valid FROM contacts""")
def valid_phone(t: BankTables):
    return contacts(t).select("customer_id", X.valid_phone(F.col("phone")).alias("valid"))


@query("normalize_phone", r"""
SELECT customer_id, coalesce(CASE WHEN trim(replace(phone, 'whatsapp:', '')) LIKE '+%' THEN '+' ELSE '' END
       || regexp_replace(phone, '\D', '', 'g'), '') AS phone FROM contacts""")
def normalize_phone(t: BankTables):
    return contacts(t).select("customer_id", X.normalize_phone(F.col("phone")).alias("phone"))


CARD = r"\b(?:\d[ -]?){9,15}(\d)[ -]?(\d)[ -]?(\d)[ -]?(\d)\b"


@query("mask_cards", rf"""
SELECT conv_id, turn, regexp_replace(text, '{CARD}', '•••• \1\2\3\4', 'g') AS text FROM (
  SELECT conv_id, turn, concat(text, ' tarjeta 4', lpad(cast(conv_id AS VARCHAR), 3, '0'), '-', lpad(cast(turn AS VARCHAR), 4, '1'),
         ' 1234 5678. Ref ', conv_id, ' fin') AS text FROM conversations) c""")
def mask_cards(t: BankTables):
    text = F.concat("text", F.lit(" tarjeta 4"), F.lpad(F.col("conv_id").cast("string"), 3, "0"), F.lit("-"),
                    F.lpad(F.col("turn").cast("string"), 4, "1"), F.lit(" 1234 5678. Ref "), F.col("conv_id").cast("string"),
                    F.lit(" fin"))
    return t.base("conversations").select("conv_id", "turn", X.mask_cards(text).alias("text"))


@query("mask_cards_documents", rf"""
SELECT doc_id, md5(regexp_replace(text, '{CARD}', '•••• \1\2\3\4', 'g')) AS masked,
       len(regexp_extract_all(text, '{CARD}')) AS cards FROM documents""")
def mask_cards_documents(t: BankTables):
    text = F.col("text")
    return t.base("documents").select("doc_id", F.md5(X.mask_cards(text)).alias("masked"),
                                      F.regexp_count(text, F.lit(X.CARD_NUMBER)).cast("bigint").alias("cards"))
