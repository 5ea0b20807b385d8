"""Part of hazeline."""
