"""Training-data operators (language identification, scoring, near duplicates,
packing, archives, chat rendering, URL filters, mixing). Nothing else in the
library imports this subpackage."""
