"""From requests to logical plans: field types, criteria and their columns."""
