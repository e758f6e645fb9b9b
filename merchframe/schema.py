"""Fixed values of the catalogue format: names, word lists, defaults and limits.

Everything here is data that results depend on; no behaviour lives in this file.
"""

# --- Fixed values: the 39 output columns, in output order -------------------------------
TARGET_COLUMNS = [
    "Title",
    "URL handle",
    "Description",
    "Vendor",
    "Product category",
    "Type",
    "Tags",
    "Published on online store",
    "Status",
    "SKU",
    "Barcode",
    "Option1 name",
    "Option1 value",
    "Option1 Linked To",
    "Option2 name",
    "Option2 value",
    "Option2 Linked To",
    "Option3 name",
    "Option3 value",
    "Option3 Linked To",
    "Price",
    "Compare-at price",
    "Cost per item",
    "Charge tax",
    "Tax code",
    "Inventory tracker",
    "Inventory quantity",
    "Continue selling when out of stock",
    "Weight value (grams)",
    "Weight unit for display",
    "Requires shipping",
    "Fulfillment service",
    "Product image URL",
    "Image position",
    "Image alt text",
    "Variant image URL",
    "Gift card",
    "SEO title",
    "SEO description",
]

# --- Fixed values: columns filled on a product's first row only -------------------------
PRODUCT_LEVEL = [
    "Title",
    "Description",
    "Vendor",
    "Product category",
    "Type",
    "Tags",
    "Published on online store",
    "Status",
    "Product image URL",
    "Image position",
    "Image alt text",
    "Gift card",
    "SEO title",
    "SEO description",
]


# --- Fixed values: defaults for blank cells ---------------------------------------------
DEFAULTS = {
    "Published on online store": "TRUE",
    "Status": "Active",
    "Inventory tracker": "shopify",
    "Continue selling when out of stock": "DENY",
    "Fulfillment service": "manual",
    "Requires shipping": "TRUE",
    "Charge tax": "TRUE",
    "Weight unit for display": "g",
}
OPTION_NAME_DEFAULTS = {1: "Size", 2: "Color", 3: "Option"}
BLANK_HANDLE = "product"

# --- Fixed values: words that mean "no value", true, false, and the known statuses ------
NULL_WORDS = ["nan", "none", "nat"]
FALSE_WORDS = ["false", "0", "no", "n", "off", "unpublished"]
TRUE_WORDS = ["true", "1", "yes", "y", "on", "published"]
SAMPLE_TRUE_WORDS = ["true", "1", "yes", "y"]
SAMPLE_FALSE_WORDS = ["false", "0", "no", "n"]
STATUS_WORDS = ["active", "draft", "archived"]

# --- Fixed values: header synonyms ------------------------------------------------------
SKIP_LABEL = "— Skip this column —"
HEADER_ALIASES = {
    "Description": [
        "description", "body", "body html", "body_html", "body (html)",
        "description / specification", "description/specification", "specification",
        "product description", "desc", "details", "product details", "about",
    ],
    "Title": ["product name", "name", "product title", "item name", "item", "title"],
    "Vendor": ["brand", "manufacturer", "supplier", "vendor name", "vendor"],
    "Price": ["price", "variant price", "raw min price", "sale price", "retail price", "cost"],
    "SKU": ["sku", "variant sku", "item sku", "product sku", "sku status", "article number"],
    "Product image URL": [
        "image url", "image src", "first image url", "product image url", "image",
        "photo url", "image link",
    ],
    "Tags": ["tag", "tags", "keywords", "labels"],
    "Type": ["product type", "category", "type"],
}

# --- Fixed values: substring rules, in the order they are tried -------------------------
KEYWORD_RULES = [
    (["handle", "slug", "url handle"], "URL handle"),
    (["compare", "original", "was", "old price", "compare-at"], "Compare-at price"),
    (["cost per"], "Cost per item"),
    (["qty", "stock", "inventory", "quantity"], "Inventory quantity"),
    (["weight", "gram", "kg"], "Weight value (grams)"),
    (["barcode", "ean", "upc", "isbn"], "Barcode"),
    (["seo title", "meta title"], "SEO title"),
    (["seo desc", "meta desc", "meta description"], "SEO description"),
    (["size"], "Option1 value"),
    (["color", "colour"], "Option2 value"),
    (["material", "flavor", "flavour", "scent"], "Option3 value"),
]

# --- Fixed values: suggestion rules for one header, in the order they are tried ---------
SUGGESTION_RULES = [
    (["title", "name", "product"], ["Title", "Description", "Vendor", "Type"]),
    (["price", "mrp", "cost", "rate"], ["Price", "Compare-at price", "Cost per item"]),
    (["sku", "code", "item", "article"], ["SKU", "Barcode"]),
    (["desc", "detail", "about", "body"], ["Description", "SEO description"]),
    (["vendor", "brand", "company"], ["Vendor", "Title"]),
    (["tag", "keyword"], ["Tags"]),
    (["type", "category"], ["Type", "Product category", "Tags"]),
    (["image", "photo", "img", "url"],
     ["Product image URL", "Variant image URL", "Image position"]),
    (["weight", "gram"], ["Weight value (grams)"]),
    (["qty", "stock", "inventory"], ["Inventory quantity"]),
    (["barcode", "ean", "upc"], ["Barcode", "SKU"]),
    (["size", "colour", "color", "material", "option"],
     ["Option1 value", "Option2 value", "Option3 value",
      "Option1 name", "Option2 name", "Option3 name"]),
    (["status", "publish", "active"], ["Status", "Published on online store"]),
    (["seo", "meta"], ["SEO title", "SEO description"]),
]

# --- Fixed values: feed files, sheets, headers, previews --------------------------------
DELIMITERS = [",", "\t", "|", ";"]
FEED_SUFFIXES = {".csv": "csv", ".xlsx": "excel", ".xls": "excel"}
HEADER_SCAN_ROWS = 10
HEADER_MIN_SHARE = 0.5
PREFERRED_SHEETS = [
    "raw merged data", "raw merged", "merged data", "products", "product data", "data",
]
SKIPPED_SHEETS = [
    "overview", "summary", "notes", "instructions", "readme", "info", "template",
    "product review", "missing data", "brand & category", "brand and category",
]
PREVIEW_ROWS = 5
PREVIEW_CHARS = {"upload": 40, "crawl": 45}
PREVIEW_FALLBACK_COLUMNS = 8
PREVIEW_PRIORITY = [
    "Title", "Vendor", "Variant Price", "Variant SKU", "Image Src", "Option1 Name",
    "Option1 Value", "Price", "SKU", "Product image URL", "Option1 name", "Option1 value",
]

# --- Fixed values: listing pages and product payloads -----------------------------------
DRAFT_COLUMNS = {
    "title": "Title",
    "url_handle": "URL handle",
    "description": "Description",
    "vendor": "Vendor",
    "product_category": "Product category",
    "type": "Type",
    "tags": "Tags",
    "sku": "SKU",
    "barcode": "Barcode",
    "option1_name": "Option1 name",
    "option1_value": "Option1 value",
    "option2_name": "Option2 name",
    "option2_value": "Option2 value",
    "option3_name": "Option3 name",
    "option3_value": "Option3 value",
    "price": "Price",
    "compare_at_price": "Compare-at price",
    "inventory_quantity": "Inventory quantity",
    "product_image_url": "Product image URL",
    "image_position": "Image position",
    "status": "Status",
}
PLACEHOLDER_OPTION_NAME = "title"
PLACEHOLDER_OPTION_VALUES = ["default title", "default"]
UK_TAX_DIVISOR = 1.2

# --- Fixed values: URL and file names ---------------------------------------------------
TWO_PART_TLDS = [
    ".co.uk", ".com.au", ".co.nz", ".co.za", ".com.br", ".org.uk", ".me.uk",
]
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".tif"]
IMAGE_TARGETS = {"WEBP": ".webp", "PNG": ".png", "JPG": ".jpg"}

# --- Fixed values: page signals ---------------------------------------------------------
TRUST_WORDS = [
    "guarantee", "secure", "trustpilot", "money back", "free return", "ssl",
    "safe checkout", "protected",
]
URGENCY_WORDS = [
    "low stock", "only left", "selling fast", "limited", "hurry", "ends soon", "last few",
]
EMAIL_VENDOR_WORDS = ["klaviyo", "mailchimp", "omnisend", "newsletter"]
SKIPPED_IMAGE_WORDS = ["icon", "logo", "sprite", "1x1", "pixel"]
DESKTOP_FOLD = 800
MOBILE_FOLD = 844
TAP_TARGET = 44
FAR_DOWN = 9999.0
