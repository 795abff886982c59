"""Schemas of the raw JSON collections, never inferred.

Inference would read the data twice and would turn the cart map into a struct with one field per
product.  Times stay ISO text here; the plans parse them.  Prices keep four decimals; a cart is only ever
written as JSON again, so its prices stay as they were read.  `finer` gives a schema whose prices keep more.
"""

PRICE = "decimal(18,4)"  # as it stands in the schemas below


def finer(schema: str, places: int) -> str:
    """A schema whose prices keep so many decimals, which the plans then add up exactly."""
    if not 4 <= places <= 18:
        raise ValueError("between 4 and 18 decimals")
    return schema.replace(PRICE, f"decimal({14 + places},{places})")


USERS = """
user_id string,
geo_data struct<city:string,state:string,country:string>,
registration_date string,
last_active string
"""

CATEGORIES = """
category_id string,
name string,
subcategories array<struct<subcategory_id:string,name:string,profit_margin:double>>
"""

PRODUCTS = """
product_id string,
name string,
category_id string,
base_price decimal(18,4),
current_stock int,
is_active boolean,
price_history array<struct<price:decimal(18,4),date:string>>,
creation_date string
"""

TRANSACTIONS = """
transaction_id string,
session_id string,
user_id string,
timestamp string,
items array<struct<
    product_id:string,
    quantity:int,
    unit_price:decimal(18,4),
    price:decimal(18,4),
    subtotal:decimal(18,4),
    line_total:decimal(18,4)>>,
subtotal decimal(14,2),
discount decimal(14,2),
total decimal(14,2),
payment_method string,
status string
"""

SESSIONS = """
session_id string,
user_id string,
start_time string,
end_time string,
duration_seconds int,
geo_data struct<city:string,state:string,country:string,ip_address:string>,
device_profile struct<type:string,os:string,browser:string>,
viewed_products array<string>,
page_views array<struct<timestamp:string,page_type:string,product_id:string,category_id:string,view_duration:int>>,
cart_contents map<string,struct<quantity:int,price:double>>,
conversion_status string,
referrer string
"""

# Other spellings of the session fields that flattening accepts, for sources that use them.
SESSIONS_ANY = (
    SESSIONS
    + """,
timestamp string,
duration int,
page_views_count int,
device struct<type:string,os:string,browser:string>,
geo struct<city:string,state:string,country:string,ip_address:string>,
device_type string,
device_os string,
browser string,
city string,
state string,
country string,
ip_address string
"""
)

COLLECTIONS = {
    "users": USERS,
    "categories": CATEGORIES,
    "products": PRODUCTS,
    "transactions": TRANSACTIONS,
}

# The unique key of each collection.
KEYS = {
    "users": "user_id",
    "categories": "category_id",
    "products": "product_id",
    "transactions": "transaction_id",
}
