"""Training-data operators: each module is one operator with a general interface
and a thin ``opN_*`` query that binds it to the tables of a data folder."""
