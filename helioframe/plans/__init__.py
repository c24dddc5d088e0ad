"""End-to-end compositions: dataset build, feature build, model comparison, quality profile."""
