"""Explicit schemas: raw feed texts as they come, normalized products, baskets."""

from __future__ import annotations

RAW_VARIANT = """struct<id:string,title:string,sku:string,price:string,compare_at_price:string,currency:string,available:string,
inventory_quantity:string,inventory_policy:string,option1:string,option2:string,option3:string,presentment_prices:string,featured_image:string>"""
#: Every scalar is read as text: a JSON number, flag or array that stands where a text may is kept as its JSON text.
FEED = f"""products array<struct<id:string,handle:string,title:string,body_html:string,vendor:string,product_type:string,tags:string,url:string,
available:string,image:string,options:array<struct<name:string,values:array<string>>>,variants:array<{RAW_VARIANT}>,images:array<struct<id:string,src:string>>>>""".replace("\n", "")
VARIANT = "struct<id:string,title:string,sku:string,price_cents:bigint,compare_at_cents:bigint,currency:string,available:boolean,options:map<string,string>>"
OPTIONS = "array<struct<name:string,values:array<string>>>"
#: A raw product, of feeds and pages alike.
RAW = f"""store_slug string, store_url string, id string, url string, title string, handle string, description string, brand string, vendor string,
product_type string, image_url string, tags array<string>, price string, currency string, availability string,
variants array<struct<id:string,title:string,sku:string,price:string,compare_at_price:string,currency:string,available:string,option1:string,option2:string,option3:string,options:map<string,string>>>,
options {OPTIONS}, source string, etag string, last_modified string""".replace("\n", " ")
PAGES = "store_slug string, url string, status int, content_type string, etag string, last_modified string, body string"
BASKET_EVENTS = "basket_id string, seq bigint, ts timestamp, op string, store_slug string, variant_id string, quantity int, unit_price bigint, handle string, title string, url string, options map<string,string>, mark boolean"
