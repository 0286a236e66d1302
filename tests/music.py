"""A music store: ten tables in a chain, for the planner (the tables need not exist) and small frames."""

from pyspark.sql import functions as F

from metricloom import element, model, repository

TABLES = {
    "customers": ("Customer", "customer_id=CustomerId*", "first_name=FirstName", "last_name=LastName", "company=Company", "country=Country", "city=City", "phone=Phone", "email=Email"),
    "invoices": ("Invoice", "invoice_id=InvoiceId*", "customer_id=CustomerId", "billing_country=BillingCountry"),
    "invoice_lines": ("InvoiceLine", "invoice_line_id=InvoiceLineId*", "invoice_id=InvoiceId", "track_id=TrackId"),
    "tracks": ("Track", "track_id=TrackId*", "album_id=AlbumId", "media_type_id=MediaTypeId", "genre_id=GenreId", "name=Name"),
    "albums": ("Album", "album_id=AlbumId*", "artist_id=ArtistId", "title=Title"),
    "artists": ("Artist", "artist_id=ArtistId*"),
    "media_types": ("MediaType", "media_type_id=MediaTypeId*", "name=Name"),
    "genres": ("Genre", "genre_id=GenreId*", "name=Name"),
    "playlists": ("Playlist", "playlist_id=PlaylistId*", "name=Name"),
    "playlist_tracks": ("PlaylistTrack", "playlist_id=PlaylistId", "track_id=TrackId"),
}
KEYS = {"customers": "customer_id", "invoices": "invoice_id", "tracks": "track_id", "albums": "album_id", "artists": "artist_id", "media_types": "media_type_id", "genres": "genre_id", "playlists": "playlist_id"}


def total(column):
    return lambda m: F.sum(F.coalesce(m.column(column), F.lit(0)))


def models():
    made = {}
    for name, (table, *columns) in TABLES.items():
        m = model(name).from_table(table)
        for c in columns:
            dimension, _, column = c.partition("=")
            m.with_dimension(dimension, "number" if dimension.endswith("_id") else "string", lambda r, c=column.rstrip("*"): r.column(c), primary_key=column.endswith("*"))
        made[name] = m
    made["artists"].with_dimension("name", "string", lambda m: m.column("Name"), format=lambda v: f"Artist: {v}")
    made["customers"].with_dimension("full_name", "string", lambda m: F.concat(m.dimension("first_name"), F.lit(" "), m.dimension("last_name")))
    made["customers"].with_metric("count", "number", lambda m: F.count_distinct(m.column("CustomerId")))
    made["invoices"].with_dimension("invoice_date", "date", lambda m: m.column("InvoiceDate"))
    made["invoices"].with_metric("total", "number", total("Total"))
    made["invoice_lines"].with_metric("quantity", "number", total("Quantity"))
    made["invoice_lines"].with_metric("unit_price", "number", total("UnitPrice"))
    made["tracks"].with_metric("unit_price", "number", total("UnitPrice"))
    return made


def equal(left, right, key):
    return lambda m: m[left].dimension(key) == m[right].dimension(key)


def store():
    r = repository()
    for m in models().values():
        r.with_model(m)
    for kind, left, right in (
        ("one_to_many", "customers", "invoices"),
        ("one_to_many", "invoices", "invoice_lines"),
        ("many_to_one", "invoice_lines", "tracks"),
        ("one_to_many", "albums", "tracks"),
        ("many_to_one", "albums", "artists"),
        ("one_to_one", "tracks", "media_types"),
        ("one_to_one", "tracks", "genres"),
        ("many_to_many", "playlists", "playlist_tracks"),
        ("many_to_many", "playlist_tracks", "tracks"),
    ):
        key = KEYS[left] if left in KEYS and kind in ("one_to_many", "many_to_many") else KEYS[right]
        r.join(kind, left, right, equal(left, right, key))
    return r


def with_hierarchies():
    r = store()
    levels = lambda *names: [element(n).with_dimensions(f"{m}.{i}", f"{m}.{t}").with_key(f"{m}.{i}").with_format([f"{m}.{t}"]) for n, m, i, t in names]
    r.with_categorical_hierarchy("artist", *levels(("artist", "artists", "artist_id", "name"), ("album", "albums", "album_id", "title"), ("track", "tracks", "track_id", "name")))
    r.models["artists"].with_categorical_hierarchy("artist", element("artist").with_dimensions("artist_id", "name").with_key("artist_id").with_format(["name"]))
    r.models["customers"].with_categorical_hierarchy(
        "personal_information",
        element("personal_information").with_dimensions("customer_id", "full_name", "first_name", "email", "phone").with_key("customer_id").with_format(["full_name"]),
    )
    return r
