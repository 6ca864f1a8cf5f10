"""News-coverage analytics as Spark DataFrame transformations, with an explicit `as_of` wherever time matters."""
