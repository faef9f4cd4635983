"""tabulon: upload-one-table analytics (profile, clean, engineer, summarise,
query pack, ad-hoc SQL, ML) as Spark DataFrame transforms."""

__version__ = "0.1.0"
